"""Secret scans: patterns find candidates, a random forest trained on labelled findings removes false positives.

The forest sees a candidate's length, character transitions and dictionary coverage, whether it is part of a path or
address, and the words next to it. Labelled findings are a parameter; the default is made here from rules with a fixed seed:
keys and passwords of common kinds in their usual places, and what is often mistaken for them.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Names that values are assigned to, prefixes of known keys, a common-word list, words next to harmless digests.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key|client[_-]?secret|bearer"
PREFIXES = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|glpat-[A-Za-z0-9_-]{20,}"
COMMON = set("the and for with from this that have not are was you your here value name file data test user admin example sample dummy change changeme default true false none null undefined string type list page index main home image video content note page http https www com org net html php path bin lib usr src build version release update config server client public private key token secret password".split())
HARMLESS = set("commit sha sha1 sha256 md5 checksum digest hash etag uuid guid revision blob tree version isbn order tracking serial phone card account".split())
HOT = set("token secret password passwd pwd apikey api key auth authorization bearer credential credentials private access client login".split())
PLACEHOLDER = re.compile(r"(?i)your|example|sample|dummy|placeholder|change.?me|insert|redacted|x{5,}|\*{3,}|^[<${%]|^(.)\1+$|^(?:0?1?2345678|abcdef)")

#: A key block: its header and, line by line (line ends may be written out), fields or key text up to its end; without an end, as much as looks like key text.
LINE = r"(?:\s|\\[nr])"
PEM = rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:(?:{LINE}+(?:[A-Z][A-Za-z-]*: [^\n]*|[A-Za-z0-9+/=]+))+{LINE}*-----END [A-Z ]{{0,30}}PRIVATE KEY-----|(?:{LINE}+[A-Za-z0-9+/]{{16,}}={{0,2}})+)"
CANDIDATE = re.compile(
    rf"(?P<pem>{PEM})"
    rf"|(?P<known>(?<![A-Za-z0-9])(?:{PREFIXES}))"
    rf"|(?<![A-Za-z0-9])(?i:{NAMES})(?:[_-][A-Za-z0-9_-]{{1,30}})?[\"']?\s{{0,3}}(?:=|:|=>)\s{{0,3}}(?:[Bb]earer )?[\"']?(?P<assigned>[^\s\"',;|&#]{{6,}})"
    rf"|(?<![A-Za-z0-9+/_=.-])(?P<bare>[A-Za-z0-9+/_-]{{20,}}={{0,2}})",
    re.S,
)
WORD = re.compile(r"[A-Za-z]+")
WINDOW = 48


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, kind: str) -> list[float]:
    """What the forest sees of a candidate; before and after: the text next to it."""
    n = len(value)
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    kinds = [_class(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    words = [w.lower() for w in WORD.findall(value)]
    covered = sum(len(w) for w in words if w in COMMON)
    vowels = sum(value.lower().count(v) for v in "aeiou")
    letters = kinds.count(0) + kinds.count(1)
    near = [w.lower() for w in WORD.findall(before)][-6:]
    then = [w.lower() for w in WORD.findall(after)][:3]
    last = re.split(r"[\s\"'=:>]+", before.strip())[-1:] or [""]
    return [
        min(n, 200),
        -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0,
        changes / max(1, n - 1),
        kinds.count(0) / max(1, n),
        kinds.count(1) / max(1, n),
        kinds.count(2) / max(1, n),
        kinds.count(3) / max(1, n),
        float(all(c in string.hexdigits for c in value)),
        covered / max(1, letters),
        max(map(len, words), default=0) / max(1, n),
        vowels / max(1, letters),
        value.count("/") + value.count(".") + value.count("\\"),
        float("://" in before[-12:] or "/" in before[-1:] or "@" in before[-1:] or "@" in after[:1] or re.match(r"\.\w{2,4}\b", after) is not None),
        float(sum(w in HOT for w in near[-2:])),
        float(any(w in HOT for w in near + then)),
        float(any(w in HARMLESS for w in near[-3:])),
        float(PLACEHOLDER.search(value) is not None),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(kind == "known"),
        float(kind == "pem"),
        float(kind == "assigned"),
        float(last[0].lower() in HOT or before[-1:] in "\"'="),
        max(counts.values(), default=0) / max(1, n),
    ]


def candidates(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, value, kind) of each candidate of the whole text."""
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup
        value = m[kind]
        start = m.start(kind)
        if kind == "assigned":
            value = value.rstrip(").]}!?*%$&")
            if len(value) < 6:
                continue
        yield start, value, kind


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, the child for smaller values (the other is next to it), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, child[at] + right, at)
            total += share[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 13) -> Forest:
    """Trees on bootstrap rows; each split is the best of a third of the features by Gini impurity over 16 thresholds."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, threshold, child, share, todo = [-1], [0.0], [0], [0.0], [(0, rows, 0)]
        while todo:
            at, rows, level = todo.pop()
            share[at] = float(y[rows].mean()) if len(rows) else 0.5
            if level >= depth or len(rows) < 2 * least or share[at] in (0.0, 1.0):
                continue
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                v = x[rows, f]
                for t in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 16))):
                    left = v <= t
                    n = left.sum()
                    if least <= n <= len(rows) - least:
                        p, q = y[rows][left].mean(), y[rows][~left].mean()
                        gain = share[at] * (1 - share[at]) - (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, t)
            if best[1] < 0:
                continue
            feature[at], threshold[at], child[at] = int(best[1]), float(best[2]), len(feature)
            left = x[rows, best[1]] <= best[2]
            for k, part in enumerate((rows[left], rows[~left])):
                todo.append((child[at] + k, part, level + 1))
                feature.append(-1), threshold.append(0.0), child.append(0), share.append(0.0)
        out.append((np.array(feature), np.array(threshold), np.array(child), np.array(share)))
    return Forest(out)


def made_findings(n: int = 4_000, seed: int = 17) -> list[tuple[str, int]]:
    """Labelled findings by rules: lines of text, each with one candidate, and 1 if it is a secret."""
    r = random.Random(seed)
    syllables = "an ber ing the on er tion ou re st en la qui de ch eau un os ar ie ment heit ge lich ado".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    chars = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    keys = ["token", "secret", "api_key", "apikey", "access_key", "password", "passwd", "client_secret", "auth_token", "private_key", "SECRET_KEY", "API-KEY"]
    assign = lambda v: r.choice(['{} = "{}"', "{}: {}", "{}={}", '"{}": "{}"', "{} = '{}'", "export {}={}"]).format(r.choice(keys), v)

    def value() -> str:
        k = r.random()
        if k < 0.4:
            return chars(r.choice([hexa, hexa.upper()]), r.choice([32, 40, 40, 64]))
        return chars(alnum + r.choice(["", "+/", "_-"]), r.choice([20, 24, 32, 40, 48, 64])) if k < 0.8 else chars(alnum + "!@%^*_-", r.randint(10, 20))

    secret = [
        lambda: assign(value()),
        lambda: assign(value()).upper() if r.random() < 0.3 else assign(value()),
        lambda: r.choice(["AKIA" + chars(string.ascii_uppercase + string.digits, 16), "ghp_" + chars(alnum, 36), "sk-" + chars(alnum, 48), "xoxb-" + chars(string.digits, 12) + "-" + chars(alnum, 24), "AIza" + chars(alnum, 35), "glpat-" + chars(alnum, 20)]),
        lambda: "eyJ" + chars(alnum, 30) + "." + chars(alnum, 60) + "." + chars(alnum, 43),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(chars(alnum + "+/", r.choice([3, 20, 64])) for _ in range(r.choice([1, 2, 6]))) + "\n-----END RSA PRIVATE KEY-----",
        lambda: "Authorization: Bearer " + chars(alnum, 40),
        lambda: r.choice(keys) + " " + chars(alnum, 40),
    ]
    harmless = [
        lambda: assign(r.choice(["your_token_here", "changeme123", "xxxxxxxxxxxxxxxx", "<your-token>", "${API_TOKEN}", "example_key_123", "********", "placeholder", "None", "true", "os.environ", "getenv(TOKEN)", "insert-key-here"])),
        lambda: assign(word() + word()),
        lambda: assign("_".join(word() for _ in range(3))),
        lambda: r.choice(["commit ", "sha1 ", "revision ", "sha256:", "md5: ", "checksum ", "etag "]) + chars(hexa, r.choice([32, 40, 64])),
        lambda: r.choice(["id ", "uuid: ", "", "order "]) + "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: "https://" + word() + ".example.com/" + word() + "/" + word() + "-" + chars(string.digits, 6) + "-" + word() + "-" + word(),
        lambda: "/usr/lib/" + word() + "/" + word() + chars(string.digits, 3) + "/" + word() + ".py",
        lambda: word() + chars(string.digits, 4) + word() + word() + word() + word(),
        lambda: "-".join([word(), word(), word(), chars(string.digits, 4), word()]),
        lambda: "img_" + chars(string.digits, 8) + "_" + word() + "_" + word() + "_large",
        lambda: word() + "_" + word() + "_v" + chars(string.digits, 3) + "_" + word() + word(),
        lambda: "".join(word().title() for _ in range(r.randint(4, 7))),
        lambda: word() + "".join(word().title() for _ in range(r.randint(3, 6))),
        lambda: "".join(word() for _ in range(r.randint(4, 8))),
        lambda: r.choice(string.ascii_letters) * r.randint(20, 60),
        lambda: "serial " + chars(string.ascii_uppercase, 3) + "-" + "-".join(chars(string.digits, 5) for _ in range(4)),
    ]
    out = []
    for k in range(n):
        label = k % 2
        line = " ".join(word() for _ in range(r.randint(0, 8)))
        out.append((f"{line} {r.choice(secret if label else harmless)()} " + " ".join(word() for _ in range(r.randint(0, 8))), label))
    return out


def trained(findings: list[tuple[str, int]] | None = None, most: int = 20_000) -> Forest:
    """A forest fit on the first `most` labelled findings (text with candidates, 1 for secrets); default: made_findings()."""
    x, y = [], []
    for text, label in (findings or made_findings())[:most]:
        for start, value, kind in candidates(text):
            x.append(features(value, text[max(0, start - WINDOW) : start], text[start + len(value) : start + len(value) + WINDOW], kind))
            y.append(float(label))
    return grow(np.array(x), np.array(y))


def spans(text: str | None, forest: Forest) -> list[tuple[int, int, str, float]]:
    """(start, length, kind, score) of all candidates in a text."""
    found = list(candidates(text or ""))
    if not found:
        return []
    x = np.array([features(v, text[max(0, a - WINDOW) : a], text[a + len(v) : a + len(v) + WINDOW], kind) for a, v, kind in found])
    return [(a, len(v), kind, float(s)) for (a, v, kind), s in zip(found, forest.scores(x))]


FINDING = "doc_id bigint, start bigint, length bigint, kind string, value string, score double, secret boolean"


def findings(docs: DataFrame, forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, start, length, kind, value, score, secret) of every candidate in every whole text; secret: score is `least` or more.

    Places are code points. Null and empty texts have none; repeated rows are scanned each, and rows without a doc_id as well. Values have
    no upper length. An empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, n, kind, t[a : a + n], s, s >= least) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for a, n, kind, s in spans(t, sent.value)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "kind", "value", "score", "secret"])

    return rows_of(docs, doc_id="bigint", text="string").mapInArrow(run, FINDING)


def redacted(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in column text replaced by a mark, and n_chars, if there is one, counted anew; no row goes."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or trained())
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for k, t in enumerate(texts):
                for a, n, _, s in reversed(spans(t, sent.value)):
                    if s >= least:
                        texts[k] = texts[k][:a] + mark + texts[k][a + n :]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out
