"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Patterns propose key blocks, strings of known issuers, values assigned to
telling names, and long runs of key-like characters. A forest then judges each
by its length, character classes and transitions, dictionary coverage, the path
around it and its neighbouring words. It is trained from labelled findings; a
set made from rules stands in where none are given.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import batch_of, id_type, map_batches, schema

#: Labelled findings that a forest is fitted on at most.
FINDINGS = 20_000
TREES, DEPTH = 40, 10
CONTEXT = 60  # characters on either side that a finding's features look at

# issuers' formats, telling and innocent neighbouring words, and common words for coverage.
ISSUERS = {
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",  # up to _CLOSE, of any length
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "url_password": r"(?<=://)[^\s:/@\"']+:[^\s:/@\"']{4,}(?=@)",
}
TELLING = "access api apikey auth authorization bearer client cred credential credentials key passphrase passwd password private pwd pw secret sign signature token".split()
INNOCENT = (
    "blob build checksum class color commit digest doc etag example file fixture git guid hash href http https id image img import index md5 module name package "
    "path ref revision sample session sha sha1 sha256 src test tree url uuid version www"
).split()
WORDS = (
    "about account after again also application array back base been before between build call case change check class client code column common config content "
    "control count create current data date default delete description detail document each element error event example field file filter find first format from "
    "function general group handle have header index info input into item just know language last length level library light like line link list load local long "
    "main make manager message method model module more most name network next node number object only option order other output over package page parent part "
    "path people place plain point process project public query read record report request response result return right role root rule same sample script search "
    "second section select server service session should show size some source space start state status step string style system table take target template test "
    "text than that their them then there these they thing think this time title token type under update user value version very view want well what when where "
    "which while window with word work world would write year your"
).split()

_RUN = r"(?<![A-Za-z0-9+/_.=~-])[A-Za-z0-9+/_.=~-]{16,}"
_ISSUED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ISSUERS.items()))
_CLOSE = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_LONG = re.compile(_RUN)
#: Strings one of which every issuer's format holds, so that most texts need no further look.
_HINTS = ("-----BEGIN ", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "k_test_", "AIza", "eyJ", "://")
_SIGN = re.compile(r"[:=]")
_NAME = re.compile(r"(?i)([a-z0-9_.-]*(?:%s)[a-z0-9_.-]*)[\"']?\s{0,3}\Z" % "|".join(sorted(TELLING, key=len, reverse=True)))
_VALUE = re.compile(r"[:=]{1,2}\s{0,3}(?i:bearer\s+)?[\"']?([^\s\"'<>,;:=][^\s\"'<>,;]{5})")  # how a value begins; it goes on to the end of _REST
_REST = re.compile(r"[^\s\"'<>,;]*")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|\.{3,}|your|example|sample|dummy|placeholder|changeme|todo|12345|abcdef|(.)\1{5,}|\$\{|<[a-z]")
_EXTENSION = re.compile(r"(?i)\.(?:py|js|ts|java|go|rs|c|h|cpp|html?|css|md|txt|json|ya?ml|toml|xml|png|jpe?g|gif|svg|pdf|csv|parquet|zip|gz|jar|com|org|net|io|dev)\b")
_CLASSES = str.maketrans({**{c: "l" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "u" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "d" for c in "0123456789"}})
FEATURES = (
    "length lower upper digit symbol entropy transition switches longest_letters vowels coverage hex base64 issuer segments extension quoted assigned "
    "telling innocent uuid placeholder distinct slashes words_before"
).split()


@dataclass(frozen=True)
class Finding:
    begin: int
    end: int
    kind: str


def candidates(text: str) -> list[Finding]:
    """Proposed secrets in order, without overlaps: issuers' formats first, then assigned values, then long runs."""
    issued: list[Finding] = []
    values: list[Finding] = []  # both in order and without overlaps

    def gaps(a: int, b: int) -> list[tuple[int, int]]:
        """What of a value no finding covers, in pieces that are long enough for values; none if its beginning is covered."""
        met = []
        for known in (issued, values):
            i = bisect_right(known, a, key=lambda f: f.begin) - 1
            i = max(i, 0)
            while i < len(known) and known[i].begin < b:
                if known[i].end > a:
                    met.append((known[i].begin, known[i].end))
                i += 1
        met.sort()
        if met and met[0][0] <= a:
            return []
        ends = [a, *(x for f in met for x in f), b]
        return [(x, y) for x, y in zip(ends[::2], ends[1::2]) if y - x >= 6]

    if any(h in text for h in _HINTS):
        at, closed = 0, True
        while m := _ISSUED.search(text, at):
            a, at = m.span()
            if m.lastgroup == "private_key":
                # Without an end after this beginning there is none after later ones either.
                close = _CLOSE.search(text, at + 16) if closed else None
                closed, at = close is not None, close.end() if close else a + 1
                if not closed:
                    continue
            issued.append(Finding(a, at, m.lastgroup))
    stop = 0
    for sign in _SIGN.finditer(text):
        i = sign.start()
        if _NAME.search(text[max(0, i - 48) : i]) and (m := _VALUE.match(text, i)):
            a = m.start(1)
            stop = stop if a < stop else _REST.match(text, a).end()
            values += [Finding(*piece, "assigned") for piece in gaps(a, stop)]
    taken = issued + values
    known = {(f.begin, f.end) for f in taken}
    last = sorted(taken, key=lambda f: f.begin)
    at = 0
    for m in _LONG.finditer(text):
        a, b = m.span()
        b -= len(m[0]) - len(m[0].rstrip(".-="))
        while at < len(last) and last[at].end <= a:
            at += 1
        if b - a >= 16 and (a, b) not in known and not (at < len(last) and last[at].begin < b):
            taken.append(Finding(a, b, "run"))
    return sorted(taken, key=lambda f: f.begin)


@lru_cache(maxsize=1)
def _transitions() -> dict[str, float]:
    """log2 probabilities of character pairs in WORDS, and of a pair never seen there under ''."""
    pairs, singles = Counter(), Counter()
    for w in WORDS:
        for a, b in zip(w, w[1:]):
            pairs[a + b] += 1
            singles[a] += 1
    out = {p: math.log2((n + 0.1) / (singles[p[0]] + 3.0)) for p, n in pairs.items()}
    out[""] = -7.0
    return out


@lru_cache(maxsize=1)
def _dictionary() -> frozenset[str]:
    return frozenset(WORDS + TELLING + INNOCENT)


def features(text: str, f: Finding) -> list[float]:
    value = text[f.begin : f.end]
    before, after = text[max(0, f.begin - CONTEXT) : f.begin], text[f.end : f.end + CONTEXT]
    n = len(value)
    classes = value.translate(_CLASSES)
    lower, upper, digit = classes.count("l"), classes.count("u"), classes.count("d")
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    small, table = value.lower(), _transitions()
    pairs = [table.get(a + b, table[""]) for a, b in zip(small, small[1:])]
    parts = _SPLIT.findall(value)
    letters = [p for p in parts if not p[0].isdigit()]
    covered = sum(len(p) for p in letters if p.lower() in _dictionary())
    words = re.findall(r"[A-Za-z0-9_]+", before)[-3:]
    near = {p.lower() for w in words for p in [w, *_SPLIT.findall(w), *w.split("_")]}
    near_after = {w.lower() for w in re.findall(r"[A-Za-z0-9]+", after)[:2]}
    trimmed = before.rstrip("\"' ")
    return [
        min(n, 200), lower / n, upper / n, digit / n, 1 - (lower + upper + digit) / n, entropy,
        sum(pairs) / len(pairs) if pairs else 0.0, sum(a != b for a, b in zip(classes, classes[1:])) / n,
        max(map(len, letters), default=0) / n, sum(c in "aeiou" for c in small) / max(1, lower + upper), covered / n,
        float(all(c in "0123456789abcdef" for c in small)), float(re.fullmatch(r"[A-Za-z0-9+/_=-]+", value) is not None),
        float(f.kind not in ("assigned", "run")), len(re.split(r"[/._-]", value)), float(_EXTENSION.search(value) is not None),
        float(before[-1:] in ("'", '"') and after[:1] == before[-1:] and before != ""), float(trimmed[-1:] in ("=", ":")),
        float(len(near & set(TELLING))), float(len((near | near_after) & set(INNOCENT))), float(_UUID.fullmatch(value) is not None),
        float(_PLACEHOLDER.search(value) is not None), len(counts) / n, float(value.count("/") + before[-1:].count("/")), float(len(words)),
    ]


class Forest:
    """Classification trees on bootstrap samples, each split chosen among a random share of the features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = 3, seed: int = 5):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[np.ndarray] = []  # per tree: feature (-1: leaf), threshold, left, right, value

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, nodes, rng)
            self.nodes.append(np.array(nodes))
        return self

    def _grow(self, x, y, level, nodes, rng) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        if level == self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        for j in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            cut = np.flatnonzero(v[:-1] < v[1:])
            cut = cut[(cut >= self.leaf - 1) & (cut < len(y) - self.leaf)]
            if not len(cut):
                continue
            a, na = t[cut], n[cut]
            b, nb = t[-1] - a, len(y) - na
            gain = a * a / na + b * b / nb - t[-1] ** 2 / len(y)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            return at
        left = x[:, best[1]] <= best[2]
        a = self._grow(x[left], y[left], level + 1, nodes, rng)
        b = self._grow(x[~left], y[~left], level + 1, nodes, rng)
        nodes[at][:4] = [best[1], best[2], a, b]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = nodes[at, 0].astype(np.int64)
                inner = feature >= 0
                if not inner.any():
                    break
                left = x[np.arange(len(x)), np.maximum(feature, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            total += nodes[at, 4]
        return total / max(1, len(self.nodes))


def made_findings(n: int = 6000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, begin, end, secret) made from rules: what issuers hand out and people paste, and what resembles it."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda chars, a, b=None: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    word = lambda: r.choice(WORDS)
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    syllables = "the ing er an re on at en nd ti es or te of ed is it al ar st to nt ha ou io le se co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
    secret = [
        lambda: of(hexes, 32), lambda: of(hexes, 40), lambda: of(hexes, 64), lambda: of(alnum, 20, 48), lambda: of(alnum + "+/", 40) + "=", lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: "ghp_" + of(alnum, 36), lambda: "sk_live_" + of(alnum, 24), lambda: "AIza" + of(alnum + "_-", 35), lambda: "xoxb-" + of("0123456789", 11) + "-" + of(alnum, 24),
        lambda: f"eyJ{of(alnum, 20)}.eyJ{of(alnum, 40)}.{of(alnum + '_-', 43)}", lambda: of(alnum + "!@#$%^&*-_", 10, 24),
    ]
    names = "token secret api_key apiKey API_KEY password passwd access_token auth_token client_secret SECRET_KEY private_key aws_secret_access_key bearer".split()
    ways = [lambda k, v: f'{k} = "{v}"', lambda k, v: f"{k}={v}", lambda k, v: f"{k}: '{v}'", lambda k, v: f'"{k}": "{v}"', lambda k, v: f"export {k.upper()}={v}", lambda k, v: f"{k}: {v}"]
    harmless_names = "commit sha256 md5 checksum digest etag revision ref uuid id build version file path url href image hash name title class import".split()
    harmless = [
        lambda: "".join(r.choice(syllables) for _ in range(r.randint(7, 14))), lambda: "_".join(word() for _ in range(r.randint(3, 6))), lambda: "-".join(word() for _ in range(r.randint(3, 6))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))), lambda: "/".join(word() for _ in range(r.randint(3, 7))) + r.choice([".py", ".json", ".html", "", ".png"]),
        lambda: "www." + "".join(word() for _ in range(2)) + ".com/" + word() + "/" + of("0123456789", 3, 6), lambda: f"{of(hexes, 8)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 12)}",
        lambda: r.choice("xX*0-=_.") * r.randint(16, 30), lambda: f"20{of('012', 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T{of('012', 2)}:00:00.000000", lambda: of("0123456789", 16, 22),
        lambda: ".".join(word() for _ in range(r.randint(3, 6))), lambda: of("0123456789", 3) + "-555-" + of("0123456789", 4) + "-" + of("0123456789", 4),
    ]
    stand_ins = ["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "changeme-changeme", "EXAMPLE_TOKEN_VALUE", "dummy_password_123", "${SECRET_TOKEN_NAME}", "os.environ.get", "placeholder_value_here", "config.settings.password", "************", "required_parameter", "getSecretFromVault"]
    out: list[tuple[str, int, int, int]] = []
    for i in range(n):
        pick = i % 10
        lead, tail = prose() + r.choice([" ", "\n", ". "]), r.choice(["", " ", "\n"]) + prose()
        if pick < 4:
            v, y = r.choice(secret)(), 1
            body = r.choice(ways)(r.choice(names), v)
        elif pick == 4:
            v, y = r.choice(secret[:11])(), 1
            body = r.choice([f"{v}", f'"{v}"', f"Authorization: Bearer {v}", f"key {v}"])
        elif pick < 7:
            v, y = r.choice(harmless)(), 0
            body = r.choice([f"{v}", f"{v}.", f"({v})", f'"{v}"', r.choice(ways)(r.choice(harmless_names), v)])
        elif pick == 7:
            v, y = r.choice([of(hexes, 7, 12), of(hexes, 32), of(hexes, 40), of(hexes, 64)]), 0
            body = r.choice([f"commit {v}", f"sha256: {v}", f"md5 {v}", f'checksum = "{v}"', f"git tree {v}", f"/objects/{v}", f"etag: {v}", f"revision={v}"])
        else:
            v, y = r.choice([r.choice(stand_ins), r.choice(harmless)()]), 0
            body = r.choice(ways)(r.choice(names), v)
        text = lead + body + tail
        at = text.index(v, len(lead))
        out.append((text, at, at + len(v), y))
    return out


def fit(findings: list[tuple[str, int, int, int]] | None = None) -> Forest:
    """A forest of labelled findings: (text, begin, end, secret). At most FINDINGS of them, in order, are used."""
    rows = (made_findings() if findings is None else findings)[:FINDINGS]
    x, y = [], []
    for text, a, b, secret in rows:
        kind = next((f.kind for f in candidates(text) if f.begin <= a and b <= f.end), "run")
        x.append(features(text, Finding(a, b, kind)))
        y.append(secret)
    return Forest().fit(np.array(x, float), np.array(y, float))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit()


def findings(text: str, forest: Forest, least: float = 0.5) -> list[tuple[Finding, float]]:
    """The candidates of a text that the forest takes for secrets."""
    found = candidates(text)
    if not found:
        return []
    scores = forest.score(np.array([features(text, f) for f in found], float))
    return [(f, float(s)) for f, s in zip(found, scores) if s >= least]


def scan_documents(docs: DataFrame, forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """A row per secret: doc_id, begin, end (characters), kind, secret_sha256, score. The secret itself is not repeated.

    Null and empty texts have none; repeated rows are scanned each; columns
    besides doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())  # bounded by TREES and DEPTH
    out = schema(("doc_id", id_type(docs)), ("begin", "int"), ("end", "int"), ("kind", "string"), ("secret_sha256", "string"), ("score", "double"))

    def scan(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for f, s in findings(text, shared.value, least) if text else ():
                    at.append(i)
                    rows.append((f.begin, f.end, f.kind, hashlib.sha256(text[f.begin : f.end].encode("utf-8", "surrogatepass")).hexdigest(), s))
            yield batch_of(out, [batch.column(0).take(pa.array(at, pa.int64())), *(map(list, zip(*rows)) if rows else [[]] * 5)])

    return map_batches(docs.select("doc_id", "text"), scan, out)


def redacted(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars, if there, brought up to date.

    Null and empty texts stay as they are, repeated rows are redacted each, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        for f, _ in reversed(findings(text, shared.value, least)):
            text = text[: f.begin] + mark + text[f.end :]
        return text

    def scan(batches):
        for batch in batches:
            text = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), text)

    out = map_batches(docs, scan, T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
