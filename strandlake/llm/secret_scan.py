"""Secret scans with a random forest against false positives, in DataFrame functions only.

Candidates are tokens of 16 and more key characters that hold a digit or change from lower to upper case, and, whatever
its length and letters, any value assigned to a name that holds a secret-naming word (``password = "hunter2"``). Each is
described by its length, its character transitions, how much of it dictionary words cover, the path it was found at and
the words next to it; a random forest, trained from labelled findings, gives the probability that it is a secret.

Findings keep the place (code points from 0) and the length. Extraction is one pass over each text; candidates are narrow
rows and do not shuffle.

Labelled findings are a table (text, path, start, secret), of which at most ``TRAINING`` rows are learned from, by hash;
``sample_findings`` makes a documented one for where none exists. The dictionary is the corpus's own: its commonest words
(``corpus_words``), counted over all documents.

Defined cases: a null or empty text has no candidates; a very long one is searched whole; a null path counts as empty.
Repeated rows give their findings again. An empty table gives an empty result, and an empty dictionary. Words of equal
count come in their order. Columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.store import stash

KEY = r"A-Za-z0-9+/_\-"
TOKEN = rf"(?<![{KEY}])(?=[{KEY}]*?(?:[0-9]|[a-z][A-Z]))[{KEY}]{{16,}}={{0,2}}"
#: A value ends at white space, a quote, a bracket, a comma or a semicolon. The first look behind is cheap and mostly fails.
ASSIGNED = (
    r"(?<=[=:>][ \t]{0,2}[\"'`]?)(?<=(?i:api_?-?key|access_?-?key|private_?-?key|auth|secret|token|passw|passphrase|pwd|credential)[A-Za-z0-9_\-]{0,16}[\"'`]?[ \t]{0,2}(?::=|=>|[=:])[ \t]{0,2}[\"'`]?)"
    r"[^\x00-\x20\"'`<>,;()\[\]{}=:][^\x00-\x20\"'`<>,;()\[\]{}]*"
)
CANDIDATE = rf"(?:{ASSIGNED}|{TOKEN})"
#: Words that sample findings are made of, and the dictionary where no corpus is given (fixed values).
DICTIONARY = "the and for that with this from have not are was you all can has will one out use new time name file path http https html index page image user data type list item value class test example sample key token string number version release config default".split()
#: Words next to a candidate that name secrets, or name other things of the same form (fixed values).
NAMES_SECRET = r"(?i)(api|access|auth|secret|token|passw|pwd|credential|private|bearer|key)"
NAMES_OTHER = r"(?i)(commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|revision|example|sample|dummy|placeholder|order|invoice|isbn|serial)"
CONTEXT, BLOCK = 40, 256
#: Labelled findings that a forest is trained on at most; words of a dictionary.
TRAINING, WORDS = 20_000, 400
FEATURES = [
    "length", "digits", "uppers", "symbols", "digit_letter", "case_changes", "repeats", "distinct", "hex_only", "digits_only", "uuid",
    "dictionary", "vowels", "path_test", "path_depth", "path_length", "near_secret", "near_other", "assigned", "quoted",
]


def corpus_words(docs: DataFrame, text: str = "text", most: int = WORDS) -> list[str]:
    """The commonest words of four to twelve letters a to z, by count over all whole texts, then in order."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z]+"), lambda w: F.length(w).between(4, 12))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(most).collect()]


def candidates(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """All columns of ``docs`` but the text, with ``start``, ``candidate``, ``before`` and ``after`` for each candidate."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = lambda group: F.regexp_extract_all(body, F.lit(rf"(?s)(.*?)({CANDIDATE}|\z)"), F.lit(group))  # noqa: E731  the last takes the rest, so no place is searched twice
    own = docs.filter(body.rlike(CANDIDATE)).withColumn("_pairs", F.arrays_zip(parts(1).alias("gap"), parts(2).alias("token")))
    # where each gap starts: running lengths within blocks of pairs, and of whole blocks
    size = lambda p: (F.length(p["gap"]) + F.length(p["token"])).cast("long")
    running = lambda sizes: F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_pairs") - 1) / BLOCK).cast("int")), lambda b: running(F.transform(F.slice("_pairs", b * BLOCK + 1, BLOCK), size)))
    own = own.withColumn("_blocks", blocks).withColumn("_ahead", running(F.transform("_blocks", lambda x: F.element_at(x, -1))))
    starts = F.flatten(F.zip_with("_blocks", F.slice("_ahead", F.lit(1), F.size("_blocks")), lambda x, n: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + n)))

    def found(p: Column, then: Column) -> Column:
        """A finding beside as much of its surroundings as is kept, so that rows stay narrow; ``then``: the next pair."""
        start = p["start"] + F.length(p["pair"]["gap"])
        after = F.coalesce(F.concat(F.left(then["gap"], F.lit(CONTEXT)), then["token"]), F.lit(""))
        return F.struct(start.alias("start"), p["pair"]["token"].alias("candidate"), F.right(p["pair"]["gap"], F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

    placed = F.zip_with("_pairs", starts, lambda p, s: F.struct(p.alias("pair"), s.alias("start")))
    all_found = F.zip_with(placed, F.slice("_pairs", F.lit(2), F.size("_pairs")), found)
    each = own.withColumn("_found", F.filter(all_found, lambda f: f["candidate"] != ""))
    # explode would infer a filter on the findings and so search each text twice
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    return each.select(*[c for c in docs.columns if c != text], where.alias("_path"), F.explode_outer("_found").alias("_f")).filter("_f IS NOT NULL").select("*", "_f.*").drop("_f")


def described(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """``found`` with the columns FEATURES, all doubles. ``words``: the dictionary; of words that overlap the longest is found first."""
    dictionary = "|".join(sorted(DICTIONARY if words is None else words, key=lambda w: (-len(w), w)))
    c, low = F.col("candidate"), F.lower("candidate")
    size = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    near = F.concat(F.col("before"), F.lit(" "), F.col("after"))
    flags: dict[str, Column] = {
        "length": F.length(c),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share(r"[+/_\-=]"),
        "digit_letter": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "case_changes": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "repeats": share(r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hex_only": low.rlike("^[0-9a-f]+$"),
        "digits_only": c.rlike("^[0-9]+$"),
        "uuid": low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "dictionary": 1 - F.length(F.regexp_replace(low, dictionary, "")) / size if dictionary else F.lit(0.0),
        "vowels": F.regexp_count(low, F.lit("[aeiou]")) / size,
        "path_test": F.lower("_path").rlike("test|example|fixture|mock|doc"),
        "path_depth": F.regexp_count("_path", F.lit("/")),
        "path_length": F.length("_path"),
        "near_secret": F.col("before").rlike(NAMES_SECRET),
        "near_other": near.rlike(NAMES_OTHER),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"'`]?$"),
        "quoted": F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]"),
    }
    return found.withColumns({k: v.cast("int").cast("double") if k in {"hex_only", "digits_only", "uuid", "path_test", "near_secret", "near_other", "assigned", "quoted"} else v.cast("double") for k, v in flags.items()})


def _assembled(found: DataFrame, words: list[str] | None) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(described(found, words))


def train(findings: DataFrame, words: list[str] | None = None, trees: int = 40, depth: int = 8, seed: int = 17, most: int = TRAINING) -> RandomForestClassificationModel:
    """A forest from labelled findings: columns text, path, start, secret; a row whose start is no candidate's is not used, nor are
    more than ``most`` rows, those least by hash."""
    known = stash(findings.select("text", "path", F.col("start").alias("_labelled"), "secret").dropna(subset=["secret"]), "findings")
    found = candidates(known, "text", "path").filter(F.col("start") == F.col("_labelled"))
    few = found.orderBy(F.xxhash64("candidate", "start", "before", "after"), "candidate", "start", "before", "after", "_path", "secret").limit(most)  # one partition of bounded rows
    rows = stash(_assembled(few, words).select("_features", F.col("secret").cast("double").alias("_secret")), "features")
    return RandomForestClassifier(featuresCol="_features", labelCol="_secret", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "path", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: id, start, length, candidate, probability, secret (false: removed as a false positive).
    ``words``: the dictionary that the model was trained with."""
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), (F.col(path) if path in docs.columns else F.lit(None).cast("string")).alias("_where"))
    scored = model.transform(_assembled(candidates(own, "_text", "_where"), words))
    chance = F.element_at(vector_to_array("probability"), 2)
    return scored.select(F.col("_id").alias(doc_id), "start", F.length("candidate").alias("length"), "candidate", chance.alias("probability"), (chance >= threshold).alias("secret"))


def sample_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """A labelled table of n findings: random keys and short passwords, named and assigned as secrets are, and look-alikes of eight kinds."""
    i, kind = F.col("id"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(20))
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}-"), i.cast("string")), 256)
    b64 = lambda salt, size: F.regexp_replace(F.substring(F.base64(F.unhex(h(salt))), 1, size), r"[\r\n]", "")
    size = pick(2, 20, 24, 32, 40)
    random_key = F.when(kind % 3 == 0, F.substring(h(3), F.lit(1), size)).when(kind % 3 == 1, b64(4, 40)).otherwise(F.concat(F.lit("ak"), F.upper(F.substring(h(5), 1, 18))))
    word = lambda salt: pick(salt, *DICTIONARY)
    words = F.concat(word(6), F.lit("-"), word(7), F.lit("_"), word(8), F.lit("/"), word(9), F.lit("2"))
    uuid = F.concat_ws("-", F.substring(h(10), 1, 8), F.substring(h(10), 9, 4), F.substring(h(10), 13, 4), F.substring(h(10), 17, 4), F.substring(h(10), 21, 12))
    digits = F.concat(F.lit("4"), F.lpad(F.conv(F.substring(h(11), 1, 12), 16, 10), 15, "7"))
    filler = F.concat(F.repeat(pick(12, "x", "0", "A", "ab"), 12), F.lit("1xx0"))
    other = F.when(kind == 6, F.substring(h(13), 1, 40)).when(kind == 7, uuid).when(kind == 8, digits).when(kind == 9, words).when(kind == 10, filler).otherwise(F.concat(word(14), word(15), F.lit("Of"), word(16), word(17), F.lit("Name")))
    # assigned values of any length: passwords, and what stands in their place in code and prose
    letters = F.translate(F.substring(h(30), 1, 5), "0123456789", "ghjkmnpqrs")
    odd = pick(31, "!", "&", ".", "@", "$", "#", "", "-")
    password = F.when(i % 3 == 0, F.concat(word(32), F.substring(F.conv(F.substring(h(33), 1, 6), 16, 10), 1, 3), odd)).when(i % 3 == 1, F.concat(F.initcap(letters), odd, F.substring(h(34), 1, 4))).otherwise(F.concat(letters, F.substring(F.translate(h(35), "0123456789", "ghjkmnpqrs"), 1, 6)))
    blank = F.when(i % 3 == 0, pick(36, "null", "None", "true", "required", "string", "str", "changeme", "xxxxxx", "******")).when(i % 3 == 1, F.concat(pick(37, "$", "os.", "config.", "self."), word(38))).otherwise(word(39))
    plain = F.concat(word(40), pick(41, "", "s", ".", "ed"))
    named = F.concat(pick(18, "api_key", "token", "secret", "password", "auth_token", "access key"), pick(19, " = \"", "=", ": '", ": ", " = "))
    lead = F.when(kind < 6, named).when(kind == 6, pick(20, "commit ", "sha1: ", "checksum = ", "revision ")).when(kind == 10, pick(21, "example token = \"", "sample key: ", "password=")).otherwise(pick(22, "see ", "in ", "id ", "the ", "order number "))
    assigned = F.concat(pick(42, "password", "passwd", "pwd", "DB_PASSWORD", "secret", "auth_token", "user_password"), pick(43, " = \"", "=", ": '", ": ", ' = "', "='"))
    lead = F.when(kind.isin(12, 13, 14), assigned).when(kind == 15, F.concat(pick(44, "the token", "a secret", "this password", "credentials"), F.lit(": "))).otherwise(lead)
    lead = F.when(kind > 15, F.concat(pick(45, "with the key", "token is", "use secret", "api key"), pick(46, " ", "\n", " `", " -> "))).otherwise(lead)  # named, not assigned
    key = F.when((kind < 6) | (kind > 15), random_key).when(kind.isin(12, 13), password).when(kind == 14, blank).when(kind == 15, plain).otherwise(other)
    before = F.concat(word(23), F.lit(" "), word(24), F.lit(" "), lead)
    close = F.when(lead.endswith('"'), '"').when(lead.endswith("'"), "'").otherwise("")
    path = F.concat(pick(25, "src/", "lib/", "tests/", "docs/", "app/config/"), word(26), pick(27, ".py", ".md", ".yaml", ".txt"))
    rows = spark.range(n).select(F.concat(before, key, close, F.lit(" "), word(28), F.lit(" "), word(29)).alias("text"), path.alias("path"), F.length(before).cast("long").alias("start"), ((kind < 6) | kind.isin(12, 13) | (kind > 15)).alias("secret"))
    return rows
