"""Secret scans, natively: candidates by patterns, false positives removed by a random forest.

A pattern finds candidates (assignments to telling names, well-known token forms, long mixed strings).
Each candidate is described by its length, character classes and transitions between them, how much of
it dictionary words cover, path marks, and the words before and after it. A random forest, grown on
the driver from labelled findings and written out as SQL conditions, scores it; candidates at or above
the threshold are secrets. Everything happens within a row: no shuffle, no Python on the executors. A candidate has no
greatest length, nor has the white space around a mark of assignment, and an assigned value no least one; a token without an
assignment or a well-known form is a candidate from 20 characters with a digit among them. Neighbouring words are those in
the BEFORE characters before a candidate and the AFTER characters behind it.

Cases: null text has no candidates and stays null when redacted; equal rows get equal results; an empty
table gives an empty result; other columns are kept by `redacted`, whatever their names, and ignored by `scan`.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

_START = r"(?<![A-Za-z0-9+/_=-])"
_KEY = r"[A-Z ]*?PRIVATE KEY(?: BLOCK)?-----"
#: A value in quotes up to the quote that closes it (on its line, escaped quotes within), or else up to white space.
#: All repetitions are possessive or of single characters, so that none of them needs a stack or looks back, however long.
_QUOTED = (
    r"\x22(?=[^\x22\r\n])[^\x22\\\r\n]*+(?:\\[^\r\n][^\x22\\\r\n]*+)*+\x22"
    r"|\x27(?=[^\x27\r\n])[^\x27\\\r\n]*+(?:\\[^\r\n][^\x27\\\r\n]*+)*+\x27"
)
_VALUE = rf"(?:{_QUOTED}|\x22[^\s\x22]++|\x27[^\s\x27]++|[^\s\x22\x27]\S*+)"
#: A key through its END line, or where that lacks, with the lines of its body.
_PEM = rf"-----BEGIN {_KEY}(?:[^-]*+(?:-{{1,4}}(?!-)[^-]*+)*+-----END {_KEY}|(?:\s*+[A-Za-z0-9+/=]{{20,}}+)*+(?:\s*+[A-Za-z0-9+/]{{0,19}}={{1,2}})?)"
#: Names whose assignment is telling, and forms of well-known tokens.
PATTERN = (
    r"(?i:(?:api|access|secret|private|auth|client|session)[_-]?(?:key|token|secret)|token|secret|passw(?:or)?d|pwd|credentials?)"
    rf"[\x22\x27]?\s*+[:=]\s*+(?![\x22\x27]?-----BEGIN {_KEY}){_VALUE}"
    rf"|{_PEM}"
    rf"|{_START}(?:AKIA|ASIA)[0-9A-Z]{{16}}"
    rf"|{_START}gh[pousr]_[A-Za-z0-9]{{30,}}+"
    rf"|{_START}(?:xox[abprs]|sk|rk|pk|glpat)[-_][A-Za-z0-9_-]{{16,}}+"
    rf"|{_START}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}(?:\.[A-Za-z0-9_-]+)?"
    rf"|{_START}(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{20,}}+"
)
#: A name and a mark of assignment before the value, and a quote after it.
ASSIGNED = r"^[A-Za-z][A-Za-z0-9_-]*+[\x22\x27]?\s*+[:=]\s*+[\x22\x27]?(?=[^=\x22\x27])"
#: Characters before and after a candidate whose words are features.
BEFORE, AFTER = 60, 40
#: Words that make up identifiers, paths and placeholders.
DICTIONARY = (
    "the and for with this that your from test demo sample example value name user data file path image index page home main "
    "class function method object string number array list table model config default version release build source module "
    "package library service server client request response content type text html json script style image icon button "
    "http https www com org net here insert change replace enter dummy placeholder password secret token key none null "
    "true false static public private assets upload download document report month date time year"
).split()
_BENIGN = r"(?i)(?:sha[-_ ]?[0-9]{0,3}|md5|digest|checksum|hash|commit|revision|blob|tree|uuid|guid|etag|version|build|id|isbn|serial|order|invoice|tracking|parcel|sum)[\x22\x27]?\s*[:=#]?\s*[\x22\x27]?$"
_TELLING = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|bearer|authorization|credential|auth|login)s?[\x22\x27]?(?:\s+(?:is|was))?\s*[:=]?\s*[\x22\x27]?$"
_NAMED = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credentials?)[\x22\x27]?\s*[:=]\s*[\x22\x27]?$"
_PLACEHOLDER = r"(?i)(?:example|sample|dummy|placeholder|your|insert|change|replace|redacted|x{4,}|1234|abcd|0000|todo|here)"

#: name -> SQL over a struct x(c: candidate, v: value, l: text before the value, r: text after the candidate).
FEATURES = {
    "length": "cast(length(x.v) as double)",
    "digits": "length(regexp_replace(x.v, '[^0-9]', '')) / greatest(length(x.v), 1)",
    "upper": "length(regexp_replace(x.v, '[^A-Z]', '')) / greatest(length(x.v), 1)",
    "symbols": "length(regexp_replace(x.v, '[A-Za-z0-9]', '')) / greatest(length(x.v), 1)",
    "transitions": "(length(regexp_replace(regexp_replace(regexp_replace(x.v, '[0-9]+', '0'), '[a-z]+', 'a'), '[A-Z]+', 'A')) - 1) / greatest(length(x.v), 1)",
    "distinct": "size(array_distinct(split(x.v, ''))) / greatest(length(x.v), 1)",
    "dictionary": f"1 - length(regexp_replace(lower(x.v), '{'|'.join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))}', '')) / greatest(length(x.v), 1)",
    "path": r"cast(length(regexp_replace(x.v, '[^/]', '')) + if(x.l rlike r'(?:://|/|\.)\S*$', 2, 0) + if(x.r rlike r'^[/.][A-Za-z]', 1, 0) as double)",
    "assigned": "if(x.c != x.v, 1D, 0D)",
    "form": f"if(x.c rlike r'^(?:AKIA|ASIA|gh[pousr]_|xox|sk[-_]|rk[-_]|glpat|eyJ|-----BEGIN)', 1D, 0D)",
    "benign": f"if(x.l rlike r'{_BENIGN}', 1D, 0D)",
    "telling": f"if(x.l rlike r'{_TELLING}' or x.l rlike r'{_NAMED}', 1D, 0D)",
    "placeholder": f"if(x.v rlike r'{_PLACEHOLDER}' or x.r rlike r'^\\W*(?:example|placeholder|dummy)', 1D, 0D)",
    "spaces": "length(regexp_replace(x.v, '[^ ]', '')) / greatest(length(x.v), 1)",
    "hexadecimal": "if(x.v rlike '^(?:[0-9a-f]+|[0-9A-F]+)$', 1D, 0D)",
    "grouped": "if(x.v rlike '^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$' or x.v rlike '^[0-9]+(?:[-./_][0-9]+)*$', 1D, 0D)",
}


def labelled_findings(n: int = 2400, seed: int = 7) -> list[tuple[str, int]]:
    """Texts with one finding each, made by rule: 1 for secrets, 0 for what only looks like one."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    case = lambda s: s.upper() if rng.random() < 0.25 else s
    names = ["token", "api_key", "apikey", "secret", "secret_key", "access_token", "password", "passwd", "auth_token", "client_secret", "private_key"]
    marks = [" = ", "=", ": ", ":", ' = "', '="', ": '"]

    def assigned(value: str, name: str | None = None) -> str:
        mark = rng.choice(marks)
        return case(name or rng.choice(names)) + mark + value + (mark[-1] if mark[-1] in "\"'" else "")

    def uuid() -> str:
        return "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12))

    def identifier(sep: str, k: int) -> str:
        return sep.join(rng.choice(DICTIONARY) for _ in range(k)) + str(rng.randrange(100))

    def block(kind: str) -> str:
        """A key with its body and END line, or the BEGIN line alone."""
        lines = [draw(alnum + "+/", 64) for _ in range(rng.randrange(0, 5))]
        head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + draw("0123456789ABCDEF", 32), ""] if rng.random() < 0.2 else []
        last = [draw(alnum + "+/", rng.randrange(5, 60)) + rng.choice(["", "=", "=="]), f"-----END {kind}PRIVATE KEY-----"]
        return rng.choice(["\n", "\n", "\\n"]).join([f"-----BEGIN {kind}PRIVATE KEY-----", *(head + lines + last if lines else [])])

    def marked(marks: str, k: int) -> str:
        """A password with punctuation anywhere in it, and sometimes white space where it is in quotes."""
        value = list(draw(alnum, k) + marks)
        rng.shuffle(value)
        name, text = rng.choice(["password", "passwd", "pwd", "db_password", "secret", "client_secret"]), "".join(value)
        if rng.random() < 0.5:
            return f"{name}{rng.choice([' = ', '=', ': ', ':'])}{text}"
        quote, at = rng.choice("\"'"), rng.randrange(1, len(text))
        return f"{name}{rng.choice([' = ', '=', ': '])}{quote}{text[:at] + ' ' + text[at:] if rng.random() < 0.2 else text}{quote}"

    def remembered() -> str:
        """A password of word-like parts with letters exchanged, punctuation between and digits."""
        part = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) + rng.choice(["ss", "rd", "n", "t", ""])
        word = part().translate(str.maketrans("aos", rng.choice(["@os", "a0s", "ao$", "@0$"])))
        return case(word[0]) + word[1:] + rng.choice("!@#%&*?") + part() + str(rng.randrange(10, 2030))

    def short() -> str:
        """A password under nine characters: letters, a digit, and more often than not a mark."""
        value = list(draw(alnum, rng.randrange(2, 6)) + draw("0123456789", 1) + draw("!@#%&*?$", rng.choice([0, 1, 1])))
        rng.shuffle(value)
        return "".join(value)

    def called() -> str:
        """A value that a program gets from somewhere else."""
        what = rng.choice(DICTIONARY)
        return rng.choice([f"get_{what}(user)", f"os.environ['{what.upper()}_KEY']", f"config.get('{what}')", f"${{{what.upper()}_SECRET}}", f"{{{{{what}_value}}}}", f"<your-{what}-here>", f"settings.{what}.value;", f"read_{what}(path),"])

    true = [
        lambda: assigned(case(draw(hexa, rng.choice([32, 40, 40, 48, 64])))),
        lambda: assigned(draw(alnum, rng.randrange(16, 56))),
        lambda: assigned(draw(alnum + "+/", 40) + rng.choice(["", "=", "=="])),
        lambda: assigned(draw(alnum + "$-_.", rng.randrange(10, 20)), rng.choice(["password", "passwd", "pwd"])),
        lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: "ghp_" + draw(alnum, 36),
        lambda: rng.choice(["sk-", "sk_live_", "xoxb-", "glpat-"]) + draw(alnum, rng.randrange(20, 48)),
        lambda: "eyJ" + draw(alnum, 24) + ".eyJ" + draw(alnum, 40) + "." + draw(alnum + "_-", 43),
        lambda: block(rng.choice(["RSA ", "", "EC ", "OPENSSH "])),
        lambda: rng.choice(["bearer ", "Authorization: Bearer ", "the key is "]) + draw(alnum, rng.randrange(24, 60)),
        lambda: marked(rng.choice(["p@ss!", "&", "#", "%", "!", "@"]), rng.randrange(6, 16)),
        lambda: marked(draw("!@#%&*?;,()", 2), rng.randrange(6, 24)),
        lambda: assigned(remembered(), rng.choice(["password", "passwd", "pwd"])),
        lambda: assigned(short(), rng.choice(["password", "passwd", "pwd", "secret", "db_password"])),
    ]
    false = [
        lambda: rng.choice(["commit ", "sha1: ", "revision ", "blob ", "tree "]) + draw(hexa, 40),
        lambda: rng.choice(["md5 ", "md5=", "checksum: ", "etag "]) + draw(hexa, 32),
        lambda: rng.choice(["sha256: ", "sha256 ", "digest="]) + draw(hexa, 64),
        lambda: rng.choice(["", "uuid ", "id=", "guid: "]) + uuid(),
        lambda: assigned(rng.choice(["your_token_here", "changeme123", "example_password", "xxxxxxxxxxxxxxxx", "INSERT-KEY-HERE", "placeholder_value", "dummy-secret-value", "1234567890abcdef", "abcdefgh12345678"])),
        lambda: assigned(rng.choice(["config", "self", "user", "request", "settings"]) + "." + identifier("_", 1)),
        lambda: identifier("_", rng.randrange(4, 8)),
        lambda: identifier("-", rng.randrange(4, 8)),
        lambda: rng.choice(["https://www.example.com/", "/usr/share/", "http://mail.example.org/files/"]) + identifier("/", rng.randrange(3, 6)),
        lambda: "https://cdn.example.net/assets/" + draw(hexa, rng.choice([20, 32, 40])) + ".png",
        lambda: rng.choice(["", "order ", "tracking ", "invoice "]) + draw("0123456789", rng.randrange(20, 30)),
        lambda: "data:image/png;base64," + "iVBORw0KGgo" + draw(alnum, 30) + "AAAA" + draw(alnum, 20),
        lambda: assigned(identifier("_", 3)),
        lambda: assigned(rng.choice(["yes", "no", "none", "null", "true", "false", "abc", "xxx", "on", "off", "here", "...", "****", "string", "required", "is", "the", "a", "my", rng.choice(DICTIONARY), str(rng.randrange(4000))])),
        lambda: rng.choice(names) + rng.choice([": ", " = "]) + rng.choice(DICTIONARY) + rng.choice([",", ".", ";", ")", ""]),
        lambda: rng.choice(names) + rng.choice([" = ", "=", ": "]) + called(),
        lambda: rng.choice(names) + rng.choice([": ", " = "]) + '"' + " ".join(rng.choice(DICTIONARY) for _ in range(rng.randrange(3, 9))) + rng.choice([".", "", "!"]) + '"',
        lambda: rng.choice(["secret", "password", "token"]) + rng.choice([": ", ":"]) + rng.choice(["everything", "something,", "forgotten.", "required,", "(optional)", "mandatory!", "incorrect;", "résumé-naïve", "contraseña"]),
        lambda: "=" * rng.randrange(10, 20) + str(rng.randrange(10)) + "=" * 12,
    ]
    out = []
    for i in range(n):
        label = int(i % 2 == 0)
        words = lambda k: " ".join(rng.choice(DICTIONARY[:40]) for _ in range(k))
        out.append((f"{words(4)} {rng.choice(true if label else false)()} {words(3)}", label))
    return out


class Forest:
    """A random forest on numpy arrays: bootstrap rows, a random subset of features a split, Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, least, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator):
        p = float(y.mean())
        if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
            return p
        best = None
        for f in rng.choice(x.shape[1], max(2, int(round(x.shape[1] ** 0.5))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, w = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= least) & (at <= len(y) - least)]
            if not len(at):
                continue
            a, b = w[at - 1] / at, (w[-1] - w[at - 1]) / (len(y) - at)
            impurity = at * a * (1 - a) + (len(y) - at) * b * (1 - b)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                best = float(impurity[i]), int(f), float((v[at[i] - 1] + v[at[i]]) / 2)
        if best is None:
            return p
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], y[low], depth - 1, least, rng), self._grow(x[~low], y[~low], depth - 1, least, rng)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(tree, row) -> float:
            while not isinstance(tree, float):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([sum(one(t, row) for t in self.trees) / len(self.trees) for row in x])

    def sql(self, names: list[str], of: str) -> str:
        """The mean of the trees' leaves as an SQL expression over fields of the struct `of`."""

        def one(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            return f"if({of}.{names[tree[0]]} <= {tree[1]!r}D, {one(tree[2])}, {one(tree[3])})"

        return "(" + " + ".join(map(one, self.trees)) + f") / {len(self.trees)}D"


def _described(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """docs with scratch columns, and the prefix of their names: _parts (texts between candidates), _cands and _found (an array of
    structs of features)."""
    t, own = F.col(text), fresh(docs, "scan")
    # an array type for every branch, so that texts without a candidate cost one look of the pattern
    docs = docs.withColumn(f"{own}_cands", F.when(t.rlike(PATTERN), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))))
    docs = docs.withColumn(f"{own}_parts", F.when(F.size(f"{own}_cands") > 0, F.split(t, PATTERN, -1)))
    lead = rf"regexp_extract(c, r'{ASSIGNED}', 0)"
    value = rf"regexp_replace(substring(c, length({lead}) + 1), r'[\x22\x27]$', '')"
    near = f"transform({own}_cands, (c, i) -> struct(c, {value} as v, concat(right({own}_parts[i], {BEFORE}), {lead}) as l, left({own}_parts[i + 1], {AFTER}) as r))"
    described = ", ".join(f"{sql} as {name}" for name, sql in FEATURES.items())
    return docs.withColumn(f"{own}_found", F.expr(f"transform({near}, x -> struct(x.c as c, x.v as v, {described}))")), own


_grown: dict[tuple, Forest] = {}


def forest(spark: SparkSession, findings: list[tuple[str, int]] | None = None, trees: int = 15, depth: int = 6) -> Forest:
    """A forest from labelled findings (texts with one candidate each); the built-in ones where none are given."""
    known = findings is None
    if known and (trees, depth) in _grown:
        return _grown[trees, depth]
    labelled = spark.createDataFrame(labelled_findings() if known else findings, "text string, label int")
    found, own = _described(labelled, "text")
    rows = found.filter(f"size({own}_found) = 1").select(F.col(f"{own}_found")[0].alias("found"), "label").collect()
    x = np.array([[r["found"][n] for n in FEATURES] for r in rows], float)
    grown = Forest(x, np.array([r["label"] for r in rows], float), trees, depth)
    if known:
        _grown[trees, depth] = grown
    return grown


def _scored(docs: DataFrame, text: str, model: Forest) -> tuple[DataFrame, str]:
    found, own = _described(docs, text)
    return found.withColumn(f"{own}_scores", F.expr(f"transform({own}_found, x -> {model.sql(list(FEATURES), 'x')})")), own


def scan(docs: DataFrame, model: Forest, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: key, n_candidates, n_secrets, the secrets' SHA-256 in order of place, the highest score, and the
    SHA-256 of the redacted text."""
    scored, own = _scored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", model)
    secret = f"filter(zip_with({own}_found, {own}_scores, (f, s) -> struct(f.v as v, s)), x -> x.s >= {threshold}D)"
    return scored.select(
        "doc_id",
        F.greatest(F.coalesce(F.size(f"{own}_cands"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_candidates"),
        F.expr(f"cast(greatest(coalesce(size({secret}), 0), 0) as bigint)").alias("n_secrets"),
        F.expr(f"coalesce(array_join(transform({secret}, x -> sha2(x.v, 256)), ','), '')").alias("secrets_sha256"),
        F.coalesce(F.array_max(f"{own}_scores"), F.lit(0.0)).alias("score"),
        F.sha2(_clean("text", own, threshold), 256).alias("redacted_sha256"),
    )


def _clean(text: str, own: str, threshold: float) -> Column:
    judged = f"zip_with({own}_found, {own}_scores, (f, s) -> struct(f.v as v, s as s))"
    swapped = f"zip_with({own}_cands, {judged}, (c, x) -> if(x.s >= {threshold}D, replace(c, x.v, '[SECRET]'), c))"
    return F.when(F.size(f"{own}_cands") > 0, F.expr(f"array_join(flatten(zip_with({own}_parts, {swapped}, (p, c) -> array(p, coalesce(c, '')))), '')")).otherwise(F.col(text))


def redacted(docs: DataFrame, model: Forest, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with every secret in the text replaced by [SECRET]; n_chars, where there is one, follows the text."""
    out, own = _scored(docs, text, model)
    out = out.withColumn(text, _clean(text, own, threshold))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(f"{own}_cands") > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
