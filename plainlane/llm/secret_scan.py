"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL operations only.

Long runs of key characters are candidates, and shorter ones that are assigned to a secret's name. What stands around a
candidate is taken from the text itself, whatever candidates that context holds. Integer features of each (length, character classes and their
transitions, distinct characters, dictionary coverage, path marks, neighbouring words) go through a forest that is trained
in numpy from labelled findings, which a seeded rule writes, and then spelled as SQL: sums of nested CASE expressions, the
same text for Spark and for DuckDB.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table

CANDIDATE = "[A-Za-z0-9_+/~.-]{16,}={0,2}"
#: Runs of key characters, and what stands before one of less than 16 that is a candidate.
RUN = "[A-Za-z0-9_+/~.-]{8,}={0,2}"
SHORT_AFTER = "(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|private.?key)[A-Za-z0-9_.-]*[^A-Za-z0-9]{0,2}[:=][ ]*[^A-Za-z0-9 ]?$"
#: Characters of context looked at, before and after.
BEFORE, AFTER = 40, 16
#: Pieces of a text whose lengths are summed at once.
LOT = 256
TREES, TREE_DEPTH, LEAF = 24, 6, 8
#: Labelled findings that the rules write for training: long ones with a digit and plain context, and all others.
FINDINGS, MORE_FINDINGS = 3000, 3000
THRESHOLD = 500

#: Words of identifiers, paths and placeholders.
DICTIONARY = (
    "access account admin alpha api app archive auth backup base beta bin build bundle cache case change changeme class client "
    "cloud code commit common config content copy core count data date default demo description dev device dist docs domain download "
    "dummy edit email entry error event example export file final first folder foo format from function github global group hash header "
    "here home host html http image import include index info input item java key label latest layout lib library license linux list "
    "local log login main manager master media message meta method model module name network node number object office open option "
    "order output package page param parent part pass password path placeholder plugin post print private process product profile project public "
    "query read release remote report request resource response result root sample script search secret section server service session "
    "setting share simple site source src start state static status storage string style support system table target task template "
    "temp test text theme time title token tool tree type unit update upload user util value version video view web widget window word work your"
)
SECRET_NEAR = "(?i)(token|secret|passw|api.?key|access.?key|auth|bearer|credential|private.?key)"
HARMLESS_NEAR = "(?i)(sha-?[0-9]|md5|commit|checksum|digest|hash|uuid|guid|etag|integrity|revision|build|version|image|layer)"
ISSUED = "^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ)"
NAMED_FILE = "[.](com|org|net|html?|js|py|java|png|jpe?g|tar|gz|zip|so|md|json|ya?ml|txt|css|xml|c|h|cc)($|[/.])"

#: name: Spark or DuckDB SQL over s, before and after, by the dialect's functions.
_SQL_FEATURES = {
    "f_length": lambda d: "length(s)",
    "f_digits": lambda d: d.count("s", "[0-9]"),
    "f_upper": lambda d: d.count("s", "[A-Z]"),
    "f_lower": lambda d: d.count("s", "[a-z]"),
    "f_marks": lambda d: d.count("s", "[^A-Za-z0-9]"),
    "f_turns": lambda d: "length(" + d.swap(d.swap(d.swap(d.swap("s", "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^A-Za-z0-9]+", "_") + ") - 1",
    "f_distinct": lambda d: d.distinct("s"),
    "f_known": lambda d: d.count("lower(s)", "(" + "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w))) + ")"),
    "f_path": lambda d: d.count("s", "[/]"),
    "f_dots": lambda d: d.count("s", "[.]"),
    "f_hex": lambda d: d.flag("s", "^[0-9a-f]+$"),
    "f_groups": lambda d: d.flag("s", "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-"),
    "f_issued": lambda d: d.flag("s", ISSUED),
    "f_file": lambda d: d.flag("s", NAMED_FILE),
    "f_secret_near": lambda d: d.flag(f"right(before, {BEFORE})", SECRET_NEAR),
    "f_harmless_near": lambda d: d.flag(f"right(before, {BEFORE})", HARMLESS_NEAR),
    "f_assigned": lambda d: d.flag(f"right(before, {BEFORE})", "[:=][ ]*[^A-Za-z0-9 ]?$"),
    "f_quoted": lambda d: d.flag(f"left(after, {AFTER})", "^[^A-Za-z0-9 ,;.)]"),
    "f_in_path": lambda d: d.flag(f"right(before, {BEFORE})", "(:/|[@#?&%])[^ ]*$"),
}
NAMES = list(_SQL_FEATURES)


class _Spark:
    @staticmethod
    def swap(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}')"

    @staticmethod
    def distinct(x: str) -> str:
        return f"size(array_distinct(split({x}, '')))"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"{x} rlike '{pattern}'"

    @classmethod
    def count(cls, x: str, pattern: str) -> str:
        return f"length({x}) - length({cls.swap(x, pattern, '')})"

    @classmethod
    def flag(cls, x: str, pattern: str) -> str:
        return f"CASE WHEN {cls.matches(x, pattern)} THEN 1 ELSE 0 END"


class _Duck(_Spark):
    @staticmethod
    def swap(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    @staticmethod
    def distinct(x: str) -> str:
        return f"len(list_distinct(string_split({x}, '')))"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"


class _Python(_Spark):
    """The same features of one finding, evaluated."""

    def __init__(self, s: str, before: str, after: str):
        self.values = {"s": s, "lower(s)": s.lower(), f"right(before, {BEFORE})": before[-BEFORE:], f"left(after, {AFTER})": after[:AFTER]}

    def features(self) -> list[int]:
        out = []
        for name, f in _SQL_FEATURES.items():
            if name == "f_length":
                out.append(len(self.values["s"]))
            elif name == "f_turns":
                x = self.values["s"]
                for p, to in (("[0-9]+", "0"), ("[A-Z]+", "A"), ("[a-z]+", "a"), ("[^A-Za-z0-9]+", "_")):
                    x = re.sub(p, to, x)
                out.append(len(x) - 1)
            else:
                out.append(f(self))
        return out

    def count(self, x, pattern):
        return len(self.values[x]) - len(re.sub(pattern, "", self.values[x]))

    def flag(self, x, pattern):
        return int(re.search(pattern, self.values[x]) is not None)

    def distinct(self, x):
        return len(set(self.values[x]))


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, label): what scanners report, half true secrets, by a seeded rule."""
    r = random.Random(seed)
    words = DICTIONARY.split()
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    text = lambda k, of: "".join(r.choices(of, k=k))
    syllables = "the ing ion ed er an re on at en nd ti es or te of is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
    natural = lambda k: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))
    out = []
    while len(out) < n:
        names = r.choice(["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "Authorization: Bearer", "private key", "credentials"])
        quote = r.choice(['"', "'", "", '"'])
        setting = natural(r.randint(0, 4)) + " " + names + r.choice([" = ", "=", ": ", " := "]) + quote
        plain = natural(r.randint(0, 6)) + " "
        kind = r.randrange(14)
        if kind < 7:  # true
            s = (
                text(r.choice([32, 40, 40, 40, 64]), hexa) if kind < 3
                else text(r.randint(20, 60), alnum + "+/_-") if kind < 5
                else r.choice(["AKIA", "ghp_", "glpat-", "xoxb-", "sk_live_", "sk-", "AIza"]) + text(r.randint(16, 40), alnum)
            )
            issued = kind >= 5
            out.append((s, plain if issued and r.random() < 0.4 else setting, quote or " " + natural(2), 1))
            continue
        after, before = " " + natural(2), plain
        if kind == 7:
            s, before = text(r.choice([32, 40, 64]), hexa), plain + r.choice(["commit ", "sha256:", "md5 = ", "checksum: ", "digest ", "hash=", "integrity sha1-", "revision "])
        elif kind == 8:
            s = "-".join(text(k, hexa) for k in (8, 4, 4, 4, 12))
            before = r.choice([plain, plain + "uuid=", plain + 'id: "'])
        elif kind == 9:
            s = "/".join(r.choices(words, k=r.randint(3, 6))) + str(r.randint(1, 99)) + r.choice([".html", ".py", ".png", ".tar.gz", "", ".so"])
            before = r.choice([plain, plain + "https://", plain + "/", plain + "path: /"])
        elif kind == 10:
            s = r.choice("_-.").join(r.choices(words, k=r.randint(3, 6))) + "_" + str(r.randint(1, 9999))
            before = r.choice([plain, setting])
        elif kind == 11:
            s, before = r.choice(["your", "example", "my", "test", "dummy"]) + r.choice("_-") + "_".join(r.choices(["api", "key", "token", "here", "secret", "placeholder", "sample", "changeme"], k=3)) + r.choice(["1234", "_0000", "1", "_xxxx1"]), setting
            after = quote or after
        elif kind == 12:
            s = r.choice([text(r.randint(16, 20), string.digits), f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{r.randint(10, 23)}-{r.randint(10, 59)}", f"+{text(12, string.digits)}-{text(4, string.digits)}"])
        else:
            s = "".join(r.choices(syllables, k=r.randint(7, 12))).capitalize() + r.choice(["1", ".2", "-3", "99."])
            s = s if len(s) >= 16 else s + "0" * (16 - len(s))
        if len(s) >= 16 and re.search("[0-9]", s):
            out.append((s, before, after, 0))
    return out


def more_findings(n: int = MORE_FINDINGS, seed: int = 12) -> list[tuple[str, str, str, int]]:
    """Findings that labelled_findings() has none of: values of long key names (which are candidates themselves), the names,
    runs without a digit, and short values that are assigned to secrets' names."""
    r = random.Random(seed)
    words = DICTIONARY.split()
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    text = lambda k, of: "".join(r.choices(of, k=k))
    syllables = "the ing ion ed er an re on at en nd ti es or te of is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
    word = lambda k: "".join(r.choices(syllables, k=k))
    natural = lambda k: " ".join(word(r.randint(1, 4)) for _ in range(k))
    holders = "aws github gitlab stripe azure google slack service client admin production staging database app my".split()
    secrets_ = "secret_access_key access_token secret_key api_key private_key auth_token client_secret password api_token credentials".split()
    harmless = "sha256 md5 checksum commit digest build revision version uuid etag".split()

    def named(last: str) -> str:
        name = "_".join([*r.choices(holders, k=r.randint(1, 2)), last])
        return r.choice([name, name.upper(), name.replace("_", "-"), name.replace("_", ".")])

    out = []
    while len(out) < n:
        quote = r.choice(['"', "'", "", '"'])
        assign = r.choice([" = ", "=", ": ", "=", '": '])
        after = quote or " " + natural(2)
        plain, kind = natural(r.randint(0, 5)) + " ", r.randrange(12)
        value = r.choice([lambda: text(r.choice([32, 40, 40, 64]), hexa), lambda: text(r.randint(20, 60), alnum + "+/_-"), lambda: text(r.randint(16, 40), string.ascii_letters)])()
        if kind < 3:
            out.append((value, plain + named(r.choice(secrets_)) + assign + quote, after, 1))
        elif kind < 5:  # a password or key of 8 to 15 characters
            short = text(r.randint(8, 15), r.choice([alnum, alnum + "_-.~+", string.ascii_letters])) if r.random() < 0.7 else word(r.randint(2, 4))[:11] + text(4, string.digits)
            out.append((short, plain + r.choice([named(r.choice(secrets_)), "password", "passwd", "token", "secret"]) + assign + quote, after, 1))
        elif kind == 5:  # the name is none
            name = named(r.choice(secrets_ + harmless))
            if len(name) >= 16:
                out.append((name + r.choice(["", "="]), plain, assign.strip() + quote + value[:8], 0))
        elif kind == 6:
            out.append((text(r.choice([32, 40, 64]), hexa), plain + named(r.choice(harmless)) + assign + quote, after, 0))
        elif kind == 7:
            s = word(r.randint(8, 14)) + r.choice(["", "", "."])
            if len(s) >= 16:
                out.append((r.choice([s, s.capitalize(), s.upper()]), r.choice([plain, plain + "\n", ""]), " " + natural(2), 0))
        elif kind == 8:
            s = r.choice(["/", "_", "-", "."]).join(r.choices(words, k=r.randint(3, 6))) + r.choice(["", ".html", ".py", "/", "."])
            if len(s) >= 16:
                out.append((s, r.choice([plain, plain + "https://", plain + "/", plain + "path: "]), " " + natural(2), 0))
        elif kind == 9:  # placeholders and words in the place of a value
            s = r.choice(["changeme", "your_password", "placeholder", "password", "example_key", "required", "undefined", "disabled", "localhost", "your-token-here", "xxxxxxxxxxxx", "********".replace("*", "x")])
            out.append((s, plain + named(r.choice(secrets_)) + assign + quote, after, 0))
        elif kind == 10:
            out.append((text(16, string.digits), r.choice([plain, plain + "| ", ""]), " " + natural(2), 0))
        else:
            out.append((r.choice(words) + r.choice("._-") + r.choice(words) + r.choice([".com", ".org", "", ".example.com"]) + "/" + r.choice(words), plain + r.choice(["@", "http://", ""]), " " + natural(1), 0))
    return [x for x in out if len(x[0]) >= 16 or re.search(SHORT_AFTER, x[1])]


class _Tree:
    """A node of a classification tree: feature and threshold, or a leaf's share of secrets in thousandths."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
        self.leaf, self.low, self.high = round(1000 * float(y.mean())), None, None
        if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
            return
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, int(x.shape[1] ** 0.5) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            cut = cut[(cut >= LEAF) & (cut <= len(y) - LEAF)]
            if not len(cut):
                continue
            a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
            impurity = a * (1 - a / cut) + b * (1 - b / (len(y) - cut))
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0]:
                best = (impurity[k], int(f), int(v[cut[k] - 1]))
        if best is not None:
            _, self.feature, self.threshold = best
            go = x[:, self.feature] <= self.threshold
            self.low, self.high = _Tree(x[go], y[go], rng, depth - 1), _Tree(x[~go], y[~go], rng, depth - 1)

    def sql(self) -> str:
        if self.low is None:
            return str(self.leaf)
        return f"CASE WHEN {NAMES[self.feature]} <= {self.threshold} THEN {self.low.sql()} ELSE {self.high.sql()} END"

    def value(self, row) -> int:
        return self.leaf if self.low is None else (self.low if row[self.feature] <= self.threshold else self.high).value(row)


@lru_cache(1)
def forest() -> list[_Tree]:
    """The forest of the rules' findings; the same one everywhere."""
    findings = labelled_findings() + more_findings()
    x = np.array([_Python(s, b, a).features() for s, b, a, _ in findings])
    y = np.array([label for *_, label in findings])
    rng = np.random.default_rng(5)
    out = []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        out.append(_Tree(x[rows], y[rows], rng, TREE_DEPTH))
    return out


def score_of(s: str, before: str, after: str) -> int:
    """The forest's score of one finding, in thousandths (for tests and trials)."""
    row = _Python(s, before, after).features()
    return sum(t.value(row) for t in forest()) // TREES


def _score_sql(divide: str) -> str:
    return divide.format("(" + " + ".join(f"({t.sql()})" for t in forest()) + ")", TREES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body asks for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(x: Column) -> Column:
    """The candidates (start, s, before, after) among a text's pieces (gaps, runs: what stands before each run).

    A fold copies its state at each step, so nothing is gathered in one: context comes from the pieces next to a run, and where a
    run starts from sums of LOT pieces, sums of these, and the pieces of its own lot.
    """
    text = lambda k: F.concat(*(F.coalesce(F.get(x, k)[name], F.lit("")) for name in ("gaps", "runs")))
    # runs have eight characters or more
    before = lambda i: F.right(F.concat(*(text(i - k) for k in range(-(-BEFORE // 8), 0, -1)), F.get(x, i)["gaps"]), F.lit(BEFORE))
    after = lambda i: F.left(F.concat(text(i + 1), text(i + 2)), F.lit(AFTER))
    run = lambda i: F.get(x, i)["runs"]
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)
    lengths = F.transform(x, lambda y: (F.length(y["gaps"]) + F.coalesce(F.length(y["runs"]), F.lit(0))).cast("long"))
    hits = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: run(i).isNotNull() & (run(i).rlike("^" + CANDIDATE) | before(i).rlike(SHORT_AFTER)))

    def placed(n: Column, firsts: Column) -> Column:
        lot = lambda i: F.floor(i / LOT).cast("int")
        start = lambda i: F.get(firsts, lot(i)) + total(F.slice(n, lot(i) * LOT + 1, i % LOT)) + F.length(F.get(x, i)["gaps"])
        return F.transform(hits, lambda i: F.struct(start(i).alias("start"), run(i).alias("s"), before(i).alias("before"), after(i).alias("after")))

    lots = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LOT).cast("int"))
    sums = lambda n: F.transform(lots, lambda b: total(F.slice(n, b * LOT + 1, LOT)))
    firsts = lambda s: F.transform(lots, lambda b: total(F.slice(s, F.lit(1), b)))
    return _let(lengths, lambda n: _let(sums(n), lambda s: _let(firsts(s), lambda f: placed(n, f))))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, nth, start, candidate, score, is_secret) of every candidate in every whole text.

    nth counts a text's candidates from 0, start is the character where one begins, score is the forest's mean in
    thousandths, is_secret whether it reaches threshold. Null and empty texts have no candidates; a null id stays null;
    repeated rows are scanned each; an empty table gives an empty one; other columns are not looked at. No shuffle, and time in
    proportion to a text's candidates: what stands around one is taken from the runs and gaps next to it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where(F.col("t").rlike(CANDIDATE) | F.col("t").rlike(f"[:=][ ]*[^A-Za-z0-9 ]?{RUN}"))
    pieces = F.arrays_zip(F.split("t", RUN).alias("gaps"), F.regexp_extract_all("t", F.lit(f"({RUN})")).alias("runs"))
    rows = texts.select("doc_id", F.posexplode_outer(_let(pieces, _found)).alias("nth", "y")).where("y is not null").select("doc_id", "nth", "y.*")
    featured = rows.selectExpr("doc_id", "nth", "start", "s", *(f"cast({f(_Spark)} as int) as {name}" for name, f in _SQL_FEATURES.items()))
    scored = featured.select("doc_id", "nth", "start", F.col("s").alias("candidate"), F.expr(_score_sql("cast({} div {} as int)")).alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents"))


@lru_cache(1)
def sql() -> str:
    features = ", ".join(f"CAST({f(_Duck)} AS INTEGER) AS {name}" for name, f in _SQL_FEATURES.items())
    return f"""
WITH t AS (SELECT doc_id, text AS t FROM documents WHERE regexp_matches(text, '{CANDIDATE}') OR regexp_matches(text, '[:=][ ]*[^A-Za-z0-9 ]?{RUN}')),
cut AS (SELECT doc_id, t, regexp_extract_all(t, '{RUN}') AS c, string_split_regex(t, '{RUN}') AS p FROM t),
flat AS (SELECT doc_id, t, c, p, unnest(range(1, len(c) + 1)) AS k FROM cut),
placed AS (SELECT doc_id, t, c[k] AS s, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(c[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM flat),
around AS (SELECT doc_id, s, start, right(left(t, start), {BEFORE}) AS before, substr(t, start + length(s) + 1, {AFTER}) AS after FROM placed),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS nth FROM around WHERE {_Duck.matches("s", "^" + CANDIDATE)} OR {_Duck.matches("before", SHORT_AFTER)}),
featured AS (SELECT doc_id, nth, start, s, {features} FROM found)
SELECT doc_id, nth, start, s AS candidate, CAST({_score_sql("{} // {}")} AS INTEGER) AS score, {_score_sql("{} // {}")} >= {THRESHOLD} AS is_secret FROM featured
"""
