"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame
functions only (dealt operator 2, native).

Candidates are values in a context that asks for a secret, and runs without one. A value is
what follows a key word and an assignment (``password=``, ``"token": "``, ``api_key => '``) or
``Authorization: Bearer``, up to the closing quote, blanks included, or else up to the next
blank, without closing punctuation, of at least ``MIN_VALUE`` characters whatever they are; and
the password in a URL's user information, of any length. Elsewhere, a candidate is a maximal
run of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/_-]`` with a digit. A whole text is cut at its candidates by native functions, so each has its start, the
text before and the text after it. Features: length, character classes and transitions
between them, distinct characters, share of hexadecimal digits, coverage by dictionary
words, what the path says (tests, examples, documentation; depth), and the neighbouring
words (a key word and an assignment before it, quotes, words that name harmless numbers),
whether a value is in a URL, refers to another (``${NAME}``, ``get(x)``, ``<password>``) or is a
plain word such as ``none`` or ``required``.

The forest (Spark ML) is trained on labelled findings: rows (before, candidate, after, path,
label). The query labels findings of the documents that aren't held out by strict formats
(:func:`labelled_findings`), at most ``PER_CLASS`` a class, and adds a fixed set of examples
of both kinds. The trained trees become one SQL expression (share of trees that vote for a
secret), so scanning and redacting are a single pass without shuffle, join or Python.

Defined cases: null and empty texts have no candidates; equal rows give equal rows; control
characters U+0001 and U+0002 in a text count as blanks while scanning; a null path is an
empty path; an empty table gives no rows; redact keeps all columns."""

from __future__ import annotations

import hashlib
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.llm.samples import held_out
from trailcast.llm.scratch import Scratch

MIN_LENGTH, PER_CLASS, TREES, DEPTH, THRESHOLD, STEP = 12, 2000, 20, 6, 0.5, 64
RUN = "A-Za-z0-9+/_\\-"
PLAIN = f"(?<![{RUN}])(?=[A-Za-z+/_\\-]*+[0-9])[{RUN}]{{{MIN_LENGTH},}}+"
#: Key words, and the name's end after them, before an assignment.
KEY = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth|account|encryption|signing)[_\-]?key|auth|credential)s?(?:[_\-]\w{1,16}|\d{1,2})?"
SIGN = r"[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}"
BEARER = r"(?i:authorization)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?i:bearer|basic|token)\s{1,3}"
MIN_VALUE = 4
#: Each begins with a short look back, so that the long one is tried at few places.
QUOTED = "|".join(f"(?<=[=:>]\\s{{0,3}}{q})(?<={KEY}{SIGN}{q})[^{q}\\r\\n]{{{MIN_VALUE},}}+(?={q})" for q in "\"'")
BARE = f"(?<=[=:>]\\s{{0,3}}[\"']?)(?<={KEY}{SIGN}[\"']?)(?![\\s\"'=:>])\\S{{{MIN_VALUE - 1},}}[^\\s.,;:?)\\]}}>\"'`]"
AFTER_BEARER = f"(?<=(?i:bearer|basic|token)\\s{{1,3}})(?<={BEARER})(?!\\s)\\S{{{MIN_VALUE - 1},}}[^\\s.,;:?)\\]}}>\"'`]"
IN_URL = r"(?<=:)(?<=://[^\s/@:\"'<>]{0,64}:)(?!//)[^\s/\"'<>]+(?=@)"
#: Two cheap looks back that every context passes come first.
IN_CONTEXT = f"(?<=[=:>\\s\"'])(?<=[=:>]|[=:>]\\s{{0,3}}[\"']|[=:>]\\s{{1,3}}|[RrCcNn]\\s{{1,3}})(?:{QUOTED}|{AFTER_BEARER}|{IN_URL}|{BARE})"
CANDIDATE = f"(?:{IN_CONTEXT}|{PLAIN})"
#: Words that make up identifiers and placeholders rather than secrets.
DICTIONARY = ("account", "admin", "alpha", "api", "app", "array", "base", "beta", "build", "cache", "change", "class", "client", "code", "config", "content", "count", "data", "date", "debug", "default", "demo", "dev", "document", "dummy", "end", "error", "event", "example", "false", "field", "file", "foo", "function", "group", "hash", "hello", "host", "html", "http", "image", "index", "info", "item", "key", "label", "lib", "line", "link", "list", "local", "log", "main", "message", "model", "module", "name", "node", "number", "object", "order", "output", "page", "param", "pass", "path", "prod", "public", "query", "release", "report", "request", "response", "result", "sample", "server", "service", "session", "size", "source", "start", "state", "string", "system", "table", "temp", "test", "text", "the", "time", "title", "token", "true", "type", "update", "user", "value", "version", "view", "window", "word", "www", "your")
KEY_WORD = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth|bearer|credential)s?(?:[_-]\w{1,16}|\d{1,2})?\W{0,6}$"
PASSWORD_WORD = r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd)s?(?:[_-]\w{1,16}|\d{1,2})?\W{0,6}$"
URL_USER = r"://[^\s/@:]*:$"
REFERENCE = r"^(?:\$\{?[A-Za-z_][\w.:\-]*\}?|<.*|\{.*|%[(\w{].*|\$[({].*|[A-Za-z_][\w.]*[(\[].*|[A-Za-z_]+(?:\.[A-Za-z_]+)+|(.)\1*)$"
WORD = r"(?i)^(?:none|null|nil|undefined|true|false|yes|no|required|optional|string|str|text|int|integer|bool|boolean|bytes|any|self|this|value|password|passwd|secret|token|hidden|redacted|removed|masked|empty|unknown|invalid|missing|expired|incorrect|wrong|enter|forgot|reset|must|should|your|the|and|is|see|use|used|using|with|from|for|new|old|not|default|example|placeholder|changed|field|input|type|name)\b"
HARMLESS = r"(?i)(?:phone|tel|fax|isbn|issn|doi|uuid|guid|sha\d*|md5|commit|checksum|digest|revision|order|invoice|card|account|id|no|number|version|build)\W{0,6}$"
TEST_PATH = r"(?i)(?:test|example|sample|mock|fixture|demo|doc|readme|lock)"
#: Strict formats that label findings: key ids with a fixed start, quoted or bare values after a
#: key word and an assignment.
FIXED_START = r"^(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24,}|xox[bp]-[0-9A-Za-z\-]{20,})$"
ASSIGNED = r"(?i)(?:password|passwd|secret|token|(?:api|access|private|secret)[_-]?key)[\"']?\s*[=:]\s*[\"']?$"
#: Starts of tokens that some services give; not labelled where nothing else tells.
TOKEN_START = r"^(?:AKIA|ASIA|AIza|ya29|gh[opusr]_|github_pat_|glpat-|gl[a-z]{2,4}-|sk[-_]|rk_|pk_|xox[a-z]-|xapp-|npm_|pypi-|hf_|dop_v1_|EAAC|eyJ)"
FEATURES = ("length", "digits", "upper", "lower", "signs", "transitions", "transition_share", "distinct_share", "hex_share", "longest_digits", "dictionary", "test_path", "path_depth", "key_word", "assigned", "quoted", "harmless", "word_before", "number_near", "password_word", "url_user", "reference", "plain_word", "other_signs")


def cut(text: Column) -> Column:
    """The text in pieces: before, candidate, between, candidate, ..., after."""
    clean = F.translate(text, "\u0001\u0002", "  ")
    return F.split(F.regexp_replace(clean, f"({CANDIDATE})", "\u0001$1\u0002"), "[\u0001\u0002]", -1)


def _once(value: Column, build) -> Column:
    """``build`` of a value that is computed once (a lambda's variable holds it)."""
    return F.element_at(F.transform(F.array(value), build), 1)


def _places(sizes: Column, then) -> Column:
    """``then`` of a function from an index to the sum of the sizes before it: whole blocks are
    added up once, so a place costs at most ``STEP`` additions and a text of n pieces n * STEP."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    blocks = lambda n: F.sequence(F.lit(0), F.floor(n / STEP).cast("int"))
    sums = F.transform(blocks(F.size(sizes)), lambda b: total(F.slice(sizes, b * STEP + 1, F.lit(STEP))))

    def with_sums(s1):
        upper = F.transform(blocks(F.size(s1)), lambda b: total(F.slice(s1, b * STEP + 1, F.lit(STEP))))
        return _once(upper, lambda s2: then(lambda i: _once(F.floor(i / STEP).cast("int"), lambda b: total(F.slice(sizes, b * STEP + 1, i % STEP))
                     + total(F.slice(s1, F.floor(b / STEP).cast("int") * STEP + 1, b % STEP)) + total(F.slice(s2, F.lit(1), F.floor(b / STEP).cast("int"))))))

    return _once(sums, with_sums)


def _number_of(parts: Column) -> Column:
    return F.floor(F.size(parts) / 2).cast("int")


def _piece(parts: Column, k: Column) -> list[Column]:
    """Before, candidate and after of a text's k-th candidate."""
    return [F.substring(F.get(parts, 2 * k), -80, 80).alias("before"), F.get(parts, 2 * k + 1).alias("candidate"), F.substring(F.get(parts, 2 * k + 2), 1, 80).alias("after")]


def findings(text: Column) -> Column:
    """Array of (start, before, candidate, after) of a whole text; before and after are the
    nearest 80 characters."""
    def build(parts):
        each = lambda place: F.transform(F.sequence(F.lit(0), _number_of(parts) - 1), lambda k: F.struct(place(2 * k + 1).alias("start"), *_piece(parts, k)))
        return _once(F.transform(parts, lambda p: F.length(p)), lambda sizes: _places(sizes, each))
    return F.when(text.rlike(CANDIDATE), _once(cut(text), build))


def _number(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("double")


def features(f: Column, path: Column) -> list[Column]:
    """The features of one finding (struct before, candidate, after) as doubles."""
    c, before, after = f["candidate"], f["before"], f["after"]
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    path = F.coalesce(path.cast("string"), F.lit(""))
    share = lambda pattern: F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / size
    flag = lambda x: x.cast("double")
    transitions = _number(c, r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[+/_\-](?=[^+/_\-])")
    covered = F.length(c) - F.length(F.regexp_replace(F.lower(c), "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
    return [size, share("0-9"), share("A-Z"), share("a-z"), share("+/_\\-"), transitions, transitions / size,
            F.size(F.array_distinct(F.split(c, ""))) / size, share("0-9a-fA-F"), flag(longest), covered / size,
            flag(path.rlike(TEST_PATH)), F.length(F.regexp_replace(path, "[^/]", "")).cast("double"),
            flag(before.rlike(KEY_WORD)), flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
            flag(before.rlike(HARMLESS)), flag(before.rlike(r"\p{L}{2,}\s$")), flag(before.rlike(r"[0-9]\W{0,3}$") | after.rlike(r"^\W{0,3}[0-9]")),
            flag(before.rlike(PASSWORD_WORD)), flag(before.rlike(URL_USER) & after.startswith("@")), flag(c.rlike(REFERENCE)), flag(c.rlike(WORD)), F.length(F.regexp_replace(c, f"[{RUN}]", "")) / size]


def examples() -> list[tuple[str, str, str, str, int]]:
    """Fixed labelled findings (before, candidate, after, path, label), made from digests."""
    digest = lambda *k: hashlib.sha256(repr(k).encode()).hexdigest()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz"
    text = lambda n, alphabet, *k: "".join(alphabet[int(digest(i, *k)[:8], 16) % len(alphabet)] for i in range(n))
    out = []
    for i in range(12):
        out += [("set password=", digest("p", i)[:16 + i], " and", "src/app.conf", 1),
                ('token = "', digest("t", i)[:40], '" then', "settings.py", 1),
                ("uses ", "AKIA" + text(16, letters[:36], "k", i), " here", "deploy/env", 1),
                ("api_key: '", text(28 + i % 8, letters, "a", i), "'", "config.yml", 1),
                ("commit ", digest("c", i)[:40], " fixes", "CHANGELOG", 0),
                ("sha256: ", digest("s", i), "", "requirements.lock", 0),
                ("card ", text(16, "0123456789", "n", i), " paid", "notes.txt", 0),
                ("the ", text(13 + i % 6, "0123456789", "m", i), " of", "report", 0),
                ("see ", f"docs/page_{i}/version-2{i}/index", " for", "docs/readme.md", 0),
                ("id ", "-".join(digest("u", i)[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))), " was", "events.log", 0),
                ("def ", f"test_user_session_token_{i}", "():", "tests/test_auth.py", 0),
                ('password = "', f"your-password-example-{i}", '"', "examples/demo.py", 0)]
        short, signed, named = text(6 + i % 5, letters[26:], "h", i), text(9 + i % 6, letters + "!&#%^*@.~?", "g", i), text(12 + i % 16, letters[:26] + letters[36:], "q", i)
        lower, number, key = text(7 + i % 8, letters[36:], "l", i), text(6 + i % 6, "0123456789", "d", i), text(10 + i, letters, "b", i)
        known = (DICTIONARY[7 * i].title() + "0rd!", DICTIONARY[5 * i + 3] + number[:3], DICTIONARY[6 * i + 1].title() + "@" + number[:4], DICTIONARY[8 * i + 2].title() + short[:3] + "!")
        out += [(("password=", "db_passwd: ", "pwd = '", '"password": "', "DB_PASSWORD_PROD='")[(i + j) % 5], v, ("", " and", "'", '",', "'")[(i + j) % 5], "src/app.conf", 1) for j, v in enumerate(known)]
        out += [(("password=", "db_passwd: ", "pwd = '", '"password": "')[i % 4], v, ("", " and", "'", '",')[i % 4], "src/app.conf", 1) for v in (short, signed, named, lower, number, f"{lower} {short} {lower[:4]}")]
        out += [(('token = "', "secret: ", 'api_key="', '"secret_key": "')[i % 4], v, ('"', "", '"', '"')[i % 4], "src/app.conf", 1) for v in (short, signed, named, key)]
        out += [(f"{('postgres', 'https', 'amqp', 'redis')[i % 4]}://{('bob', 'app', '', 'root')[i % 4]}:", v, "@db/x", "src/app.conf", 1) for v in (short, signed, lower, number)]
        out += [("Authorization: Bearer ", key, "", "src/call.sh", 1)]
        words = ("None", "null", "required", "string", "optional", "str", "true", "hidden", "value", "bytes", "must", "your")
        calls = ("get_password(user)", "os.environ[\"DB_PASS", "${DB_PASSWORD}", "<password>", "{{ vault.password }}", "%s", "self.token", "args.secret", "config.get(\"token", "$TOKEN", "xxxxxxxx", "********")
        out += [(before, v[i], after, path, 0) for v in (words, calls) for before, after, path in (("password=", "", "src/app.py"), ("token: ", ",", "src/app.py"), ('"secret": "', '"', "src/app.json"), ("api_key = ", "", "settings.py"))]
        out += [("max_tokens: ", number[:6], "", "src/app.conf", 0), ("tokens = ", number[:4], "", "settings.py", 0), ("https://host:", f"{8000 + i}/user", "@db", "README.md", 0),
                ("postgres://user:", words[i] if i % 2 else "${DB_PASSWORD}", "@db/x", "README.md", 0)]
    return out


def example_rows(spark: SparkSession) -> DataFrame:
    names = ("before", "candidate", "after", "path", "label")
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, e))) for e in examples()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def labelled_findings(docs: DataFrame, scratch: Scratch, per_class: int = PER_CLASS, text_col: str = "text", id_col: str = "doc_id", path_col: str | None = "source") -> DataFrame:
    """Findings of rows that aren't held out, labelled by strict formats: 1 for a fixed start or
    a mixed value assigned to a key word, 0 for a run that no key word precedes and that has no
    known start of a token (other findings teach nothing); at most ``per_class`` a class, chosen
    by hash."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    rows = (docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), path.alias("path"), F.explode(findings(F.col(text_col))).alias("f"))
            .select("id", F.coalesce("path", F.lit("")).alias("path"), "f.before", "f.candidate", "f.after", "f.start"))
    c = F.col("candidate")
    # values of doubtful kinds teach nothing: in a URL, or in context only
    rows = rows.where(~(F.col("before").rlike(URL_USER) & F.col("after").startswith("@")) & c.rlike(PLAIN))
    rows = rows.withColumn("label", (c.rlike(FIXED_START) | (F.col("before").rlike(ASSIGNED) & c.rlike("[a-zA-Z]"))).cast("int"))
    rows = rows.where((F.col("label") == 1) | ~(F.col("before").rlike(KEY_WORD) | c.rlike(TOKEN_START)))
    rows = scratch.write(rows, "findings")                 # both classes read them
    order = (F.xxhash64("candidate", "id", "start"), "candidate", "id", "start")
    parts = [rows.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1]).select("before", "candidate", "after", "path", "label")


class Forest:
    """A trained forest as text; :meth:`score` is its SQL expression."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, values: list[Column]) -> Column:
        """Share of the trees that call it a secret."""
        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            k, at, low, high = node
            return F.when(values[k] <= at, walk(low)).otherwise(walk(high))
        total = F.lit(0.0)
        for t in self.trees:
            total = total + walk(t)
        return total / float(len(self.trees))


def _tree(lines: list[str]):
    """A tree from the model's printed form."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return float(head.split(":")[1])
    k, at = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", head).groups()
    low = _tree(lines)
    lines.pop(0)                                       # Else
    high = _tree(lines)
    return low if low == high else (int(k), float(at), low, high)


def train_model(labelled: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH):
    """(Spark ML's forest, the feature rows) of labelled findings (before, candidate, after, path, label)."""
    f = F.struct("before", "candidate", "after")
    columns = features(f, F.col("path"))
    rows = scratch.write(labelled.select(*(c.alias(n) for c, n in zip(columns, FEATURES)), F.col("label").cast("double").alias("label")).coalesce(1), "labelled")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(vectors), vectors


def forest_of(model) -> Forest:
    """The model's trees as a :class:`Forest`."""
    return Forest([_tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees])


def train(labelled: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH) -> Forest:
    return forest_of(train_model(labelled, scratch, trees, depth)[0])


def fit(docs: DataFrame, per_class: int = PER_CLASS, **columns) -> Forest:
    """Train on the documents' labelled findings and the fixed examples."""
    scratch = Scratch(docs.sparkSession, "secrets")
    labelled = labelled_findings(docs, scratch, per_class, **columns).unionByName(example_rows(docs.sparkSession))
    forest = train(labelled, scratch)
    scratch.drop("labelled", "findings")
    return forest


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", path_col: str | None = "source") -> DataFrame:
    """Every candidate of every whole text: id, start, length, value_sha256, score, secret."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.explode(findings(F.col(text_col))).alias("f"))
    rows = rows.select("id", "f", *(c.alias(n) for c, n in zip(features(F.col("f"), F.col("path")), FEATURES)))
    score = forest.score([F.col(n) for n in FEATURES])
    return rows.select(F.col("id").alias(id_col), F.col("f.start").alias("start"), F.length("f.candidate").cast("long").alias("length"), F.sha2(F.col("f.candidate"), 256).alias("value_sha256"), score.alias("score")).withColumn("secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, mark: str = "[SECRET]", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, and n_chars (if there is one) counted
    anew for the texts that changed."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    text = F.col(text_col)

    def rebuilt(parts):
        def is_bad(k):
            valued = _once(F.struct(*_piece(parts, k)), lambda f: F.array(*features(f, path)))
            return _once(valued, lambda v: forest.score([F.get(v, F.lit(i)) for i in range(len(FEATURES))]) >= threshold)

        def joined(bad):                               # judged once for all pieces
            kept = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when((i % 2 == 1) & F.get(bad, F.floor(i / 2).cast("int")), F.lit(mark)).otherwise(F.get(parts, i)))
            return F.when(F.exists(bad, lambda b: b), F.array_join(kept, ""))

        return _once(F.transform(F.sequence(F.lit(0), _number_of(parts) - 1), is_bad), joined)

    changed = F.when(text.rlike(CANDIDATE), _once(cut(text), rebuilt))
    out = {text_col: F.coalesce("redacted__", text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("redacted__").isNull(), F.col("n_chars")).otherwise(F.length("redacted__")).cast(dict(docs.dtypes)["n_chars"])
    return docs.withColumn("redacted__", changed).withColumns(out).select(*docs.columns)
