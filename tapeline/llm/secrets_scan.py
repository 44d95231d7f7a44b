"""Secret scans: candidate strings by a byte scan, false positives removed by a random forest over candidate length,
character transitions, dictionary coverage, path and neighbouring words.

Candidates are runs of key characters from LEAST characters on, whatever their kind, and those from MIXED on with a
letter and a digit, with their padding; such runs joined by dots; and any value of SHORT or more characters that a
secret word assigns by = or :, quoted or bare, whatever its characters. The forest decides; kept candidates that
overlap are one finding. Shorter values, and words or numbers under LEAST that nothing assigns, are not looked at:
nothing tells them from prose.

The forest is trained here from labelled findings, by default a seeded set of FINDINGS rows that a generator
writes: keys and tokens of common forms where they are assigned, against hashes, identifiers, paths, encoded data
and placeholders. Each tree is grown in a Spark task. Texts are scanned in one pass, without a shuffle.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import release, released, slices, texts, words

FINDINGS = 6_000
TREES = 48
DEPTH = 12
LEAST = 16
MIXED = 8
SHORT = 6
KEY = 128
NEAR = 48

# Common words of prose and code, for the share of a candidate that words cover.
WORDS = (
    "about account action address after again apple array author backup before between black blue board border build button cache call change chapter "
    "check class client close cloud code color column command commit common config content control count create data date default delete detail device "
    "display document domain dummy edit element email empty enable error event example export false field file filter first folder form format frame "
    "front function global green group handler header height here hidden history home host image import index info input insert item label language "
    "last layer layout length level library light line link list local login main manager master message method middle model module month name number "
    "object option order other output package page panel parent part path people place plain player point post price print private process product "
    "profile project public query random range read record report request reset response result return right root sample save schema score screen "
    "search section select server service session setting shadow shape short sign simple size sort source space standard start state status store "
    "street string style submit summary system table target task template test text their there thing this time title token total type under update "
    "upload user value version view water week while width window with word world write year your"
).split()
# Words that stand near secrets, near harmless strings, and in paths of tests and examples.
SECRET_WORDS = rb"token|secret|passw|pwd|api[_-]?key|apikey|auth|credential|private|access|bearer|client_secret|signing"
HARMLESS_WORDS = rb"commit|sha-?\d|md5|checksum|digest|uuid|guid|hash|revision|etag|integrity|build|version|example|sample|dummy|placeholder|your|base64|href|src=|url|http|class=|id="
TEST_PATHS = r"test|example|sample|mock|fixture|doc|vendor|demo"
# What stands in the place of a secret without being one.
PLACEHOLDERS = rb"your|example|change_?me|x{4}|\*{3}|dummy|placeholder|insert|^<.*>$|\$\{|\{\{|^\$|%\(|getenv|environ|process\.env|^(?:none|null|true|false|undefined|string|str|bytes|varchar|optional|required|disabled|enabled|default|public|private|protected|granted|denied|restricted|invalid|missing|expired|hidden)\b"

_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"+/_-", *range(48, 58), *range(65, 91), *range(97, 123)]] = True
_DIGIT, _ALPHA = np.zeros(256, np.int64), np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_ALPHA[[*range(65, 91), *range(97, 123)]] = 1
_CLASS = np.zeros(256, np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_DICTIONARY = re.compile("|".join(sorted(WORDS, key=lambda w: (-len(w), w))).encode())
_AFTER_KEY = rb"[A-Za-z0-9_.-]*[\"'`\])]{0,3}[ \t]*(?::[ \t]*[A-Za-z][A-Za-z0-9_.\[\]|]*[ \t]*)?"
_KEY = re.compile(rb"(?:" + SECRET_WORDS + rb")" + _AFTER_KEY + rb"\Z", re.I)
_SECRET_KEY = re.compile(rb"(?:" + SECRET_WORDS.replace(b"auth", b"auth(?!or(?!i[sz]))") + rb")" + _AFTER_KEY + rb"[:=]{1,3}>?[ \t]*(?:bearer[ \t]+)?[\"'`]{0,3}(?:bearer[ \t]+)?\Z", re.I)
_PASSWORD_KEY = re.compile(rb"(?:passw|pwd)" + _AFTER_KEY + rb"[:=]{1,3}>?[ \t]*[\"'`]{0,3}\Z", re.I)
_BARE = rb"(?:[^\s\"'`,;&<]|[\"'`](?=[A-Za-z0-9])|<(?![/A-Za-z!])|[,;&](?=[^\s\"'`])(?![A-Za-z0-9_.-]+[\"'`]?[ \t]*[=:]))"
_VALUE = re.compile(rb"[:=]{1,3}>?[ \t]*(?:bearer[ \t]+)?(?:([\"'`])(?:bearer[ \t]+)?((?:\\.|(?!\1)[^\\\r\n]){%d,})\1|[\"'`]{0,3}(%s{%d,}))" % (SHORT, _BARE, SHORT), re.I)
_PLACEHOLDER = re.compile(PLACEHOLDERS, re.I)
_NEAR_SECRET, _NEAR_HARMLESS, _TESTS = re.compile(SECRET_WORDS, re.I), re.compile(HARMLESS_WORDS, re.I), re.compile(TEST_PATHS, re.I)
FEATURES = (
    "length transitions digits upper lower symbols distinct entropy hexadecimal longest_run dictionary vowels groups "
    "assigned quoted secret_before harmless_before secret_after harmless_after word_before digits_only_tail test_path known_prefix "
    "secret_key password_key placeholder calls spaces dots padding"
).split()


def features(before: bytes, candidate: bytes, after: bytes, path: str) -> list[float]:
    """The values of FEATURES for a candidate between its neighbouring bytes."""
    n = len(candidate)
    raw = np.frombuffer(candidate, np.uint8)
    kind = _CLASS[raw]
    share = np.bincount(kind, minlength=4) / n
    counts = np.bincount(raw)
    p = counts[counts > 0] / n
    small = candidate.lower()
    covered = sum(len(w) for w in _DICTIONARY.findall(small))
    runs = np.diff(np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [n]]))
    lead = before.rstrip(b" \t\"'`")
    return [
        n, float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, share[1], share[2], share[3], share[0], len(p) / n, float(-(p * np.log2(p)).sum()),
        float(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", candidate) is not None), float(runs.max()), covered / n, sum(c in b"aeiou" for c in small) / n, float(len(re.split(rb"[-_/+]", candidate))),
        float(lead.endswith((b"=", b":", b"=>"))), float(before[-1:] in (b'"', b"'", b"`") and after[:1] in (b'"', b"'", b"`")),
        float(_NEAR_SECRET.search(before) is not None), float(_NEAR_HARMLESS.search(before) is not None), float(_NEAR_SECRET.search(after[:24]) is not None), float(_NEAR_HARMLESS.search(after[:24]) is not None),
        float(re.search(rb"[A-Za-z]{3,}[ \t]*$", before) is not None), float(re.fullmatch(rb"[A-Za-z_-]+\d{1,8}", candidate) is not None), float(_TESTS.search(path) is not None),
        float(re.match(rb"AKIA|ASIA|ghp_|gho_|glpat-|xox[abps]-|sk-|sk_live|pk_live|eyJ|AIza", candidate) is not None),
        float(_SECRET_KEY.search(before) is not None), float(_PASSWORD_KEY.search(before) is not None), float(_PLACEHOLDER.search(candidate) is not None), float(re.search(rb"[A-Za-z_][(\[]", candidate) is not None),
        float(candidate.count(b" ")), float(candidate.count(b".")), float(candidate.endswith(b"=")),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 23) -> pd.DataFrame:
    """before, candidate, after, path, label: a seeded set of findings, about half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung che que ción ment".split()
    word = lambda: pick(WORDS) if rng.random() < 0.5 else "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    path = lambda: pick(["src/app", "config", "deploy/env", "web/page", "notes", "src", "tests/data", "docs/examples", "crawl", "mail"]) + str(int(rng.integers(30)))
    letters, leet = string.ascii_letters, str.maketrans("aeios", "43105")
    syllabic = lambda low, high: "".join(pick(syllables) for _ in range(int(rng.integers(low, high))))
    jwt = lambda: ".".join(["eyJ" + chars(alnum, int(rng.integers(14, 40))), "eyJ" + chars(alnum + "_-", int(rng.integers(20, 120))), chars(alnum + "_-", int(rng.integers(27, 60)))])
    rows = []
    for _ in range(n):
        ending = pick([" ", "\n", "*** ", "%%% ", ", ", "### ", ". "]) + prose(4)
        if rng.random() < 0.5:
            key = pick(["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key", "db_password", "signing_secret", "bearer"])
            key = pick([key, key.upper(), key.title()])
            value = pick([
                lambda: chars(hexes, int(rng.choice([20, 32, 40, 48, 64]))), lambda: chars(hexes.upper(), int(rng.choice([32, 40]))), lambda: chars(alnum, int(rng.integers(18, 60))),
                lambda: chars(alnum + "+/", int(rng.integers(24, 64))), lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + chars(alnum, 36), lambda: "sk-" + chars(alnum, 40),
                lambda: "eyJ" + chars(alnum + "_-", 60), lambda: chars(alnum + "_-", int(rng.integers(20, 44))),
            ])()
            quote, sign = pick(['"', '"', '"', "'", ""]), pick([" = ", "=", ": ", ":", " => "])
            if rng.random() < 0.4:  # short, of one kind of characters, with other characters, padded, dotted
                value = pick([
                    lambda: (pick(WORDS) + pick(WORDS)).title().translate(leet)[: int(rng.integers(8, 15))] + chars(string.digits, 2), lambda: (syllabic(2, 5).title().translate(leet) + chars(string.digits, int(rng.integers(1, 5)))).ljust(6, "7"),
                    lambda: chars(alnum, int(rng.integers(6, 18))), lambda: chars(string.ascii_lowercase, int(rng.integers(8, 33))), lambda: chars(letters, int(rng.integers(6, 40))), lambda: chars(string.digits, int(rng.integers(6, 33))),
                    lambda: chars(alnum + "!@$#%^*.?~", int(rng.integers(8, 33))), lambda: pick(WORDS).title() + str(int(rng.integers(1950, 2030))) + pick("!@$#?"), lambda: chars(alnum + "+/", int(rng.integers(10, 62))) + pick(["=", "=="]), jwt, jwt,
                ])()
                if rng.random() < 0.1:
                    key, value = pick(["password", "db_password", "PASSWORD", "pwd"]), (pick([word(), syllabic(2, 4)]) + chars(string.digits, int(rng.integers(1, 4)))).rjust(6, "k")
                elif rng.random() < 0.1:  # words as a password, where it is quoted
                    key, value, quote = pick(["password", "db_password", "PASSWORD", "admin_pwd"]), pick([" ", "-", ""]).join(pick(WORDS) for _ in range(int(rng.integers(2, 5)))), pick(['"', "'"])
                if quote and rng.random() < 0.2:
                    key, sign = f"{quote}{key}{quote}", pick([": ", ":"])
            if rng.random() < 0.15:  # told, not assigned
                told = pick(["the password is ", "password is now ", "my token is ", "use the api key ", "api key ", "the secret key is ", "access token ", "private key is ", "with the bearer token ", "login with password "])
                rows.append((prose(3) + " " + told, pick([lambda: chars(alnum, int(rng.integers(10, 41))), lambda: chars(letters, int(rng.integers(18, 41))), lambda: chars(hexes, int(rng.choice([16, 32, 40]))), lambda: chars(string.digits, int(rng.integers(16, 25))), lambda: (syllabic(2, 4).title().translate(leet) + chars(string.digits, 3)).ljust(9, "4")])(), ending, path(), 1))
                continue
            rows.append((prose(4) + pick([" ", "\n", "*** ", "| "]) + key + sign + quote, value, quote + ending, path(), 1))
            continue
        if rng.random() < 0.25:  # words, numbers and names of their kind, and short mixtures
            before = prose(int(rng.integers(2, 5))) + pick([" ", " ", "\n", " (", ", "]) + pick(["", "", "", "the ", "id ", "number ", "order ", "phone ", "file ", "room "])
            value = pick([
                lambda: pick([str, str.upper])(syllabic(7, 13).replace("ó", "o").ljust(16, "e")), lambda: "".join(pick(WORDS).title() for _ in range(int(rng.integers(3, 6)))).ljust(16, "s"), lambda: "-".join(word().replace("ó", "o") for _ in range(int(rng.integers(3, 6)))).ljust(16, "s"), lambda: "_".join(pick(WORDS) for _ in range(int(rng.integers(3, 5)))).ljust(16, "s"),
                lambda: chars(string.digits, int(rng.integers(16, 21))), lambda: "/".join(pick(WORDS) for _ in range(4)).ljust(16, "s"), lambda: pick(["-", "_", "=", "+"]) * int(rng.integers(16, 60)), lambda: pick(WORDS) + chars(string.digits, int(rng.integers(1, 5))).rjust(4, "1"), lambda: (pick(WORDS).upper()[:3] + "-" + chars(string.digits, 6)), lambda: str(int(rng.integers(1990, 2030))) + "-" + pick(["jan", "feb", "mar"]) + "-" + str(int(rng.integers(10, 28))),
                lambda: (chars(string.digits, 2) + pick(WORDS) + chars(string.digits, 2)).ljust(8, "0"), lambda: "v" + str(int(rng.integers(9))) + pick(["alpha", "beta", "release"]) + str(int(rng.integers(99))), lambda: chars(hexes, 8), lambda: "x".join([chars(string.digits, 4), chars(string.digits, 4)]), lambda: pick(["a", "e", "x", "ha", "na"]) * int(rng.integers(16, 40)), lambda: word().replace("ó", "o").rjust(7, "b") + "2",
            ])()
            rows.append((before, value, ending, path(), 0))
            continue
        if rng.random() < 0.4:  # assigned by a secret word, or dotted or padded, and no secret
            key = pick(["token", "secret", "password", "api_key", "auth_token", "access_key", "client_secret", "db_password", "PASSWORD", "Token"])
            before, value, after = pick([
                lambda: (prose(3) + " " + key + pick([": ", " = ", ": \""]), pick(["string", "String", "optional", "required", "undefined", "disabled", "default", "varchar(255)", "Optional[str]", "None_or_str"]), ending),
                lambda: (prose(3) + " " + key + pick([" = ", "=", ": "]), pick(["os.getenv", "get_secret", "getpass.getpass", "config.get", "self.client.login", "next_token", "load"]) + "(" + pick(['"', "'", ""]) + pick([pick(WORDS), pick(WORDS).upper() + "_PASSWORD"]), pick(['")', "')", ")"]) + ending),
                lambda: (prose(3) + " " + key + pick([" = ", "=", ": "]), pick(["self.", "config.", "settings.", "request.", "process.env.", "args."]) + "_".join(pick(WORDS) for _ in range(int(rng.integers(1, 3)))), ending),
                lambda: (prose(3) + " " + key + pick([' = "', '="', ': "']), pick(["********", "<" + pick(WORDS) + ">", "${" + pick(WORDS).upper() + "}", "$" + pick(WORDS).upper() + "_KEY", "{{ " + pick(WORDS) + " }}", "changeme", "xxxxxxxx", "your-" + pick(WORDS) + "-here", "your_" + pick(WORDS), "example-" + pick(WORDS)]), '"' + ending),
                lambda: (prose(3) + " " + pick(["token", "access", "private", "secret", "authorship", "Access", "auth", "signing", "Secret", "password"]) + ": ", pick([pick([w for w in WORDS if len(w) >= 6]), syllabic(3, 6).ljust(6, "e")]), " " + prose(4)),
                lambda: (prose(3) + " " + pick(["author", "Author", "authors", '"author"']) + pick([': "', ' = "']), syllabic(2, 4).title() + " " + syllabic(2, 4).title().ljust(4, "n"), '"' + ending),
                lambda: (prose(3) + " " + pick(["token", "access", "private", "secret", "auth", "api_key"]) + pick([': "', ' = "']), prose(int(rng.integers(4, 9))), '"' + ending),
                lambda: (prose(4) + " ", ".".join(word().replace("ó", "o") for _ in range(int(rng.integers(2, 5)))) + str(int(rng.integers(99))) + pick([".com", ".html", ".min.js", ".tar.gz", ""]), ending),
                lambda: (prose(3) + " https://", pick(["www", "cdn", "img2"]) + "." + syllabic(2, 4).replace("ó", "o") + pick([".com/", ".org/", ".de/"]) + "/".join(pick(WORDS) for _ in range(3)) + str(int(rng.integers(999))), ending),
                lambda: ('src="data:image/png;base64,', chars(alnum + "+/", int(rng.integers(60, 200))) + pick(["=", "=="]), '"' + ending),
                lambda: (prose(3) + " " + pick(["commit", "md5", "checksum", "build", "digest"]) + pick([": ", " = ", "="]), pick([chars(hexes, 32), chars(hexes, 40), chars(alnum + "+/", 43) + "="]), ending),
            ])()
            rows.append((before, value, after, path(), 0))
            continue
        before, value, after = pick([
            lambda: (prose(5) + " commit ", chars(hexes, 40), ending), lambda: (prose(4) + " sha256:", chars(hexes, 64), ending), lambda: ("checksum = \"", chars(hexes, 32), "\"" + ending),
            lambda: (prose(3) + ' id="', "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), '"' + ending), lambda: ('src="data:image/png;base64,', chars(alnum + "+/", int(rng.integers(60, 200))), '"' + ending),
            lambda: (prose(4) + " ", "".join(pick(WORDS).title() for _ in range(4)) + str(int(rng.integers(1, 999))), ending), lambda: (prose(2) + " see ", "/".join(pick(WORDS) for _ in range(4)) + str(int(rng.integers(99))), ending),
            lambda: ("api_key = \"", pick(["your_api_key_here_1", "xxxxxxxxxxxxxxxxxxxx1", "EXAMPLE_KEY_0123456789", "changeme_changeme_1", "insert_token_here_2024", "dummy_secret_value_1"]), "\"" + ending),
            lambda: ("token = ", "_".join(pick(WORDS) for _ in range(3)) + str(int(rng.integers(1, 99))), ending), lambda: (prose(6) + " ", "-".join(["order", str(int(rng.integers(2000, 2030))), chars(string.digits, 8)]), ending),
            lambda: (prose(5) + " ", "".join(pick(syllables) for _ in range(9)).replace("ó", "o") + str(int(rng.integers(9))), ending), lambda: ('integrity="sha384-', chars(alnum + "+/", 64), '"' + ending),
            lambda: ("https://mail.example.com/", "-".join(word() for _ in range(4)).replace("ó", "o") + "-" + str(int(rng.integers(10**6))), ending),
        ])()
        rows.append((before, value, after, path(), 0))
    return pd.DataFrame(rows, columns=["before", "candidate", "after", "path", "label"])


@dataclass
class Forest:
    """Trees in flat arrays, one after the other: feature -1 marks a leaf, whose threshold is its share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    roots: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                right = x[rows, np.maximum(self.feature[node], 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.threshold[node]
        return total / max(len(self.roots), 1)


def grow(x: np.ndarray, y: np.ndarray, seed: int, depth: int = DEPTH, least: int = 3) -> list[tuple[int, float, int]]:
    """(feature, threshold, left child; the right one follows) of a tree over a bootstrap sample, by Gini impurity
    over about the square root of the features at each node."""
    rng = np.random.default_rng(seed)
    sample = rng.integers(0, len(y), len(y))
    nodes: list[tuple[int, float, int]] = [(-1, 0.0, 0)]
    todo = [(0, sample, 0)]
    while todo:
        at, rows, level = todo.pop()
        own = y[rows]
        nodes[at] = (-1, float(own.mean()), 0)
        if level == depth or len(rows) < 2 * least or own.min() == own.max():
            continue
        best = None
        for j in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, j], kind="stable")
            value, hits = x[rows, j][order], np.cumsum(own[order])
            k = np.arange(1, len(rows))
            cut = (value[1:] > value[:-1]) & (k >= least) & (len(rows) - k >= least)
            if not cut.any():
                continue
            a, b = hits[:-1] / k, (hits[-1] - hits[:-1]) / (len(rows) - k)
            impurity = np.where(cut, k * a * (1 - a) + (len(rows) - k) * b * (1 - b), np.inf)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                middle = float((value[i] + value[i + 1]) / 2)
                best = (impurity[i], int(j), middle if middle < value[i + 1] else float(value[i]))
        if best is None:
            continue
        _, j, threshold = best
        right = x[rows, j] > threshold
        nodes[at] = (j, threshold, len(nodes))
        todo += [(len(nodes), rows[~right], level + 1), (len(nodes) + 1, rows[right], level + 1)]
        nodes += [(-1, 0.0, 0)] * 2
    return nodes


def fit_forest(spark: SparkSession, findings: pd.DataFrame | None = None, trees: int = TREES) -> Forest:
    """A forest from labelled findings (before, candidate, after, path, label), a Spark task for each few trees."""
    findings = labelled_findings() if findings is None else findings
    made = [features(b.encode()[-NEAR:], c.encode(), a.encode()[:NEAR], p) for b, c, a, p in findings[["before", "candidate", "after", "path"]].itertuples(index=False)]
    shared = spark.sparkContext.broadcast((np.array(made), findings["label"].to_numpy(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                yield pd.DataFrame(grow(*shared.value, int(tree)), columns=["feature", "threshold", "left"]).assign(tree=tree).rename_axis("node").reset_index()

    rows = spark.range(0, trees, 1, min(trees, 12)).mapInPandas(run, "node long, feature int, threshold double, left long, tree long").toPandas().sort_values(["tree", "node"])
    roots = np.concatenate([[0], np.cumsum(rows.groupby("tree").size().to_numpy())])[:-1].astype(np.int64)
    shift = np.repeat(roots, rows.groupby("tree").size().to_numpy())
    return Forest(rows["feature"].to_numpy(np.int64), rows["threshold"].to_numpy(), rows["left"].to_numpy(np.int64) + shift, roots)


def assigned(data: np.ndarray, offsets: np.ndarray, least: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the values of `least` or more bytes that a secret word assigns by = or :.

    A quoted value ends at its quote; a bare one at a space, a quote, a tag, or a comma, semicolon or & that ends it
    or that a further key follows, and without the punctuation after it. Keys are looked for in KEY bytes."""
    sign = (data == 0x3D) | (data == 0x3A)
    first = sign.copy()
    first[1:] &= ~sign[:-1]
    places = np.flatnonzero(first)
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    rows = np.searchsorted(offsets, places, side="right") - 1
    raw, found, done = data.tobytes(), [], 0
    for row, at in zip(rows.tolist(), places.tolist(), strict=True):
        low, high = int(offsets[row]), int(offsets[row + 1])
        if at < done or not _KEY.search(raw[max(low, at - KEY) : at]) or not (match := _VALUE.match(raw, at, high)):
            continue
        start, end = match.span(2) if match[1] else match.span(3)
        if not match[1]:
            done = end if end - start > 2 * KEY else done
            while end > start and (raw[end - 1] in b".,;:" or any(raw[end - 1] == shut and opened not in raw[start:end] for opened, shut in zip(b"([{", b")]}", strict=True))):
                end -= 1
        if end - start >= least:
            found.append((row, start, end))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def candidates(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of key characters, with = or == after them, that are long enough, or a little
    shorter and of letters and digits, of those runs joined by dots, and of the assigned values; each place once."""
    starts, ends, count = words(data, offsets, _TOKEN)
    row = np.repeat(np.arange(len(count)), count)
    stop = offsets[row + 1]
    byte = lambda at: np.where(at < stop, data[np.minimum(at, len(data) - 1)], 0x20) if len(data) else at
    equal = [byte(ends + k) == 0x3D for k in range(3)]
    padding = np.where(equal[0] & equal[1] & ~equal[2], 2, np.where(equal[0] & ~equal[1], 1, 0))
    padded = ends + np.where(_TOKEN[byte(ends + padding)], 0, padding)
    dotted = np.zeros(len(starts), bool)
    dotted[1:] = (starts[1:] == ends[:-1] + 1) & (row[1:] == row[:-1]) & (byte(ends)[:-1] == 0x2E)
    head = np.flatnonzero(~dotted)
    tail = np.append(head[1:], len(starts))[: len(head)] - 1
    several = tail > head
    row, starts, ends = (np.concatenate([x, y]) for x, y in ((row, row[head[several]]), (starts, starts[head[several]]), (padded, padded[tail[several]])))
    some = np.flatnonzero(ends - starts >= min(MIXED, least))
    starts, ends, row = starts[some], ends[some], row[some]
    count = lambda kind: (sums := np.concatenate([[0], np.cumsum(kind[data])]))[ends] - sums[starts]
    good = (ends - starts >= least) | (count(_DIGIT) > 0) & (count(_ALPHA) > 0)
    found = np.concatenate([np.stack([row[good], starts[good], ends[good]]), np.stack(assigned(data, offsets))], axis=1)
    return tuple(np.unique(found.astype(np.int64), axis=1))


def _scored(part, forest: Forest, paths: list[str]) -> tuple[np.ndarray, ...]:
    row, start, end = candidates(part.data, part.offsets)
    made = []
    for r, a, b in zip(row, start, end, strict=True):
        low, high = part.offsets[r], part.offsets[r + 1]
        made.append(features(part.data[max(low, a - NEAR) : a].tobytes(), part.data[a:b].tobytes(), part.data[b : min(high, b + NEAR)].tobytes(), paths[r]))
    score = forest.probability(np.array(made)) if made else np.zeros(0)
    return row, start - part.offsets[row], end - part.offsets[row], score


def _kept(part, forest: Forest, paths: list[str], least_score: float) -> tuple[np.ndarray, ...]:
    """Row, start, end and best score of the candidates that the forest keeps; those that overlap are one."""
    row, start, end, score = (x.tolist() for x in _scored(part, forest, paths))
    found: list[list] = []
    for r, a, b, p in zip(row, start, end, score, strict=True):
        if p < least_score:
            continue
        if found and found[-1][0] == r and a < found[-1][2]:
            found[-1][2:] = [max(b, found[-1][2]), max(p, found[-1][3])]
        else:
            found.append([r, a, b, p])
    columns = list(zip(*found, strict=True)) or [()] * 4
    return *(np.array(c, np.int64) for c in columns[:3]), np.array(columns[3], np.float64)


def secrets(documents: DataFrame, forest: Forest, *, least_score: float = 0.5, path_column: str | None = None) -> DataFrame:
    """doc_id, start, end (bytes), score of every finding that the forest keeps, with the string's SHA-256.

    path_column names a column with each text's path or source. Null and empty texts have no findings; equal rows
    are reported each for itself."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)
    path = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                paths = batch.column("path").slice(part.first, len(part)).to_pylist()
                row, start, end, score = _kept(part, shared.value, paths, least_score)
                found = [part.data[part.offsets[r] + a : part.offsets[r] + b].tobytes() for r, a, b in zip(row, start, end, strict=True)]
                docs = batch.column("doc_id").slice(part.first, len(part)).take(pa.array(row))
                yield pa.record_batch([docs, pa.array(start), pa.array(end), pa.array(score), pa.array(found, pa.binary())], ["doc_id", "start", "end", "score", "string"])

    found = texts(documents, path.alias("path")).mapInArrow(released(run), "doc_id long, start long, end long, score double, string binary")
    return found.select("doc_id", "start", "end", "score", F.sha2("string", 256).alias("sha256"))


def redacted(documents: DataFrame, forest: Forest, *, least_score: float = 0.5, path_column: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of documents with `mark` in place of each secret in text; a null text stays null. Only the
    text and its path go to Python."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)
    path = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")

    @F.arrow_udf("string")
    def clean(column: pa.Array, paths: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for part in slices(column.fill_null("")):
            row, start, end, _ = _kept(part, shared.value, paths.slice(part.first, len(part)).to_pylist(), least_score)
            cut: dict[int, list[tuple[int, int]]] = {}
            for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                cut.setdefault(r, []).append((a, b))
            for i in range(len(part)):
                raw = part.bytes(i)
                for a, b in reversed(cut.get(i, ())):
                    raw = raw[:a] + mark.encode() + raw[b:]
                out.append(raw.decode("utf-8", errors="replace") if column[part.first + i].is_valid else None)
        release()
        return pa.array(out, pa.string())

    return documents.withColumn("text", clean("text", path))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all texts of documents."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit_forest(spark), path_column="source")
