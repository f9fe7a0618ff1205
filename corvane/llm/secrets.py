"""Secret scans: patterns propose candidates, a random forest removes false positives.

The forest sees a candidate's length, its character transitions and entropy, how much of it a
small dictionary covers, whether it stands in a path, and the words next to it. It is trained
in numpy from labelled findings: a table of (text, start, end, label), at most
``MAX_FINDINGS`` rows (about as many, drawn by a hash); without one, a seeded set of findings as they occur in code,
configuration and prose. Texts are scanned whole, each on its own, a batch at a time.

Defined cases: null or empty text has no candidate; a very long text or candidate is read
whole; overlapping candidates keep the first, longest one; repeated rows are scanned one by
one; a null doc_id is kept; an empty table gives an empty result; further columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, table

MAX_FINDINGS = 50_000
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_ASSIGNED = re.compile(
    r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|api[_\-]?key|access[_\-]?key|private[_\-]?key)[\"']?\s*(?:=>|[:=])\s*(?:[\"']([^\"'\s]{6,})[\"']|([^\"'\s,;()\[\]{}<>]{6,}))"
)
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
_DIGIT = re.compile(r"[0-9]")
_PREFIXED = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|sk[-_]|pk_live|rk_live|xox[abprs]-|AIza|eyJ|npm_|pypi-|SG\.)")
_NEAR = re.compile(r"[A-Za-z]+")
GOOD = frozenset("token key keys secret secrets password passwd pwd passphrase credential credentials auth authorization bearer apikey api access private client session".split())
BAD = frozenset(
    "commit sha sha1 sha256 md5 checksum digest hash integrity uuid guid revision rev version build example sample placeholder test dummy blob tree image data png jpeg base64 path file url href src id etag fingerprint".split()
)
_DICTIONARY = frozenset(
    "about access account action address admin after again align application array async background bottom button cache center change child class client click close code color column component config connect console container content control count create custom data database date default delete description device dialog disable display document domain download editor element email enable error event example export extension factory false feature field file filter first folder font footer form format forward frame function gateway global group handler header height hidden home host http icon image import index info inline input install instance interface internal item javascript language layout left length level library license limit link linux list load local location login main manager margin master message method middle model module mouse name network node normal number object offset open option order output package padding page parent password path placeholder plugin point position prefix process product profile project property protocol provider public query reader readme record reference region register release remote render replace report request reset resource response result return right root route sample schema script search section select server service session setting shared simple size source standard start state static status storage string style submit support switch system table target template test text theme thread time title token toolbar total transaction type unit update upload user utils value variable vendor version video view visible warning width window worker wrapper your here this that with from".split()
)
_MAX_WORD = max(map(len, _DICTIONARY))
FEATURES = "length digits uppers lowers others transitions entropy hexadecimal uuid coverage longest_run repeats ascending prefixed assigned quoted good_word bad_word near_slash near_dot in_url words_before".split()


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates, in order and disjoint."""
    out = [(m.start(), m.end(), "private_key") for m in _PEM.finditer(text)] if "-----BEGIN " in text else []
    if ":" in text or "=" in text:
        out += [(*m.span(m.lastindex), "assigned") for m in _ASSIGNED.finditer(text)]
    for m in _RUN.finditer(text):
        if _DIGIT.search(m[0]) or _PREFIXED.match(m[0]):
            out.append((m.start(), m.end(), "random"))
    out.sort(key=lambda c: (c[0], -c[1]))
    kept: list[tuple[int, int, str]] = []
    for c in out:
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


def _coverage(s: str) -> float:
    """Share of the letters that dictionary words of four and more letters cover, greedily."""
    low, i, covered = s.lower(), 0, 0
    while i < len(low) - 3:
        for n in range(min(_MAX_WORD, len(low) - i), 3, -1):
            if low[i : i + n] in _DICTIONARY:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, len(s))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    n = max(1, len(s))
    kinds = list(map(_kind, s))
    freq = np.bincount(np.frombuffer(s.encode("utf-8", "replace"), "uint8"), minlength=1)
    freq = freq[freq > 0] / max(1, freq.sum())
    run = best = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    left, right = text[max(0, start - 48) : start], text[end : end + 24]
    before = [w.lower() for w in _NEAR.findall(left.split("\n")[-1])][-4:]
    after = [w.lower() for w in _NEAR.findall(right.split("\n")[0])][:2]
    near = before + after
    pairs = [s[i : i + 2] for i in range(0, n - 1)]
    return [
        end - start,
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(-(freq * np.log2(freq)).sum()),
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(bool(re.fullmatch(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", s))),
        _coverage(s),
        best / n,
        1 - len(set(pairs)) / max(1, len(pairs)),
        sum(ord(b) - ord(a) == 1 for a, b in zip(s, s[1:], strict=False)) / n,
        float(bool(_PREFIXED.match(s)) or s.startswith("-----BEGIN")),
        float(bool(re.search(r"(?:=>|[:=])\s*[\"']?$", left))),
        float(left[-1:] in ("'", '"') and right[:1] == left[-1:]),
        float(sum(w in GOOD or any(w.endswith(g) for g in ("token", "secret", "password", "key")) for w in before)),
        float(sum(w in BAD for w in near)),
        float(left[-1:] == "/" or right[:1] == "/" or s.count("/") >= 2 and not s.endswith("=")),
        float(left[-1:] == "." or bool(re.match(r"\.\w", right))),
        float("://" in left),
        len(before),
    ]


@dataclass
class Forest:
    trees: list[list[tuple]]  # nodes (feature, cut, left, right, share); feature -1: a leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes in self.trees:
            for i, row in enumerate(x):
                k = 0
                while nodes[k][0] >= 0:
                    k = nodes[k][2] if row[nodes[k][0]] <= nodes[k][1] else nodes[k][3]
                out[i] += nodes[k][4]
        return out / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 3) -> Forest:
    """Random forest: bootstrap rows, a random subset of features at each node, Gini gain."""
    rng = np.random.default_rng(seed)
    tried = max(2, int(math.sqrt(x.shape[1])) + 1)

    def build(rows: np.ndarray, level: int, nodes: list) -> int:
        own, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return own
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], y[rows[order]].cumsum()
            n = np.arange(1, len(rows) + 1)
            left = 2 * t * (n - t) / n
            rest, total = len(rows) - n, t[-1]
            right = np.where(rest > 0, 2 * (total - t) * (rest - (total - t)) / np.maximum(rest, 1), 0)
            gain = 2 * total * (len(rows) - total) / len(rows) - left - right
            gain[:-1][v[:-1] == v[1:]] = 0
            gain[: leaf - 1] = 0
            gain[len(rows) - leaf :] = 0
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), int(f), float((v[k] + v[min(k + 1, len(v) - 1)]) / 2))
        if best[1] < 0:
            return own
        goes = x[rows, best[1]] <= best[2]
        a = build(rows[goes], level + 1, nodes)
        b = build(rows[~goes], level + 1, nodes)
        nodes[own] = (best[1], best[2], a, b, share)
        return own

    out = []
    for _ in range(trees):
        nodes: list[tuple] = []
        build(rng.integers(0, len(y), len(y)), 0, nodes)
        out.append(nodes)
    return Forest(out)


def labelled_findings(n: int = 3000, seed: int = 17) -> list[tuple[str, int, int, int]]:
    """Seeded labelled findings (text, start, end, label), half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    b64 = low + up + dig + "+/"
    prose = ["the", "and", "with", "note", "then", "of", "in", "we", "set", "use", "value", "see", "la", "der", "que", "on"]
    words = lambda k: " ".join(rng.choice(prose, k))
    vocab = sorted(_DICTIONARY)

    def good() -> tuple[str, str, str]:
        body = [
            lambda: pick(hexa, rng.choice([32, 40, 48, 64])),
            lambda: pick(hexa, rng.choice([32, 40, 64])).upper(),
            lambda: pick(b64, rng.integers(20, 64)),
            lambda: pick(low + up + dig, rng.integers(18, 48)),
            lambda: pick(low + up + dig + "!@#%^&", rng.integers(10, 24)),
            lambda: "AKIA" + pick(up + dig, 16),
            lambda: "ghp_" + pick(low + up + dig, 36),
            lambda: "sk-" + pick(low + up + dig, 40),
            lambda: "xoxb-" + pick(dig, 12) + "-" + pick(low + up + dig, 24),
            lambda: "AIza" + pick(low + up + dig + "_-", 35),
            lambda: pick(low, rng.integers(12, 32)),
            lambda: str(rng.choice(vocab)) + pick(dig, rng.integers(1, 5)) + str(rng.choice(vocab)),
            lambda: pick(low, rng.integers(5, 9)) + pick(dig, rng.integers(1, 4)) + pick(low + "!@#%", rng.integers(2, 7)),
        ][rng.integers(13)]()
        name = str(rng.choice(["token", "api_key", "secret", "password", "access_token", "client_secret", "auth_token", "key", "TOKEN", "apiKey", "SECRET_KEY"]))
        form = rng.integers(8)
        if len(body) < 18 or body.isalpha():  # no run of signs that shows by itself
            form = rng.integers(4) if rng.random() < 0.6 else 7
        if form == 7:
            return f"{name}{rng.choice(['=', ' = ', ': '])}", body, ""
        if form == 6:
            return f"{name.upper()}=", body, ""
        if form < 3:
            return f'{name}{rng.choice([" = ", "=", ": "])}"', body, '"'
        if form == 3:
            return f"export {name.upper()}=", body, ""
        if form == 4:
            return "Authorization: Bearer ", body, ""
        return f"{name} is ", body, " "

    def bad() -> tuple[str, str, str]:
        form = rng.integers(13)
        hx = pick(hexa, rng.choice([32, 40, 64]))
        if form == 0:
            return f"{rng.choice(['commit', 'sha1:', 'rev', 'checksum', 'md5', 'sha256:', 'digest', 'revision'])} ", hx, ""
        if form == 1:
            u = pick(hexa, 32)
            return f"{rng.choice(['id', 'uuid', 'guid', 'request'])}{rng.choice([' = ', ': ', ' '])}", "-".join([u[:8], u[8:12], u[12:16], u[16:20], u[20:]]), ""
        if form == 2:
            return "/", "/".join(rng.choice(vocab, 3)) + "/lib" + pick(dig, 2), ".so"
        if form == 3:
            return " ", str(rng.choice(vocab)) + "-" + str(rng.choice(vocab)) + "-" + str(rng.choice(vocab)) + "-" + pick(dig, 2), " "
        if form == 4:
            return f'{rng.choice(["token", "password", "api_key", "secret"])} = "', str(rng.choice(["your_token_here_123", "xxxxxxxxxxxxxxxxxxxx1", "example_password_1234", "1234567890123456", "changeme", "placeholder_value_01", "insert-key-here-0000", "aaaaaaaaaaaaaaaa1111", "test_secret_test_01"])), '"'
        if form == 5:
            return "data:image/png;base64,", pick(b64, rng.integers(60, 200)), ""
        if form == 6:
            return f"https://{rng.choice(vocab)}.org/", "/".join(rng.choice(vocab, 2)) + "/" + pick(dig, 6), ""
        if form == 7:
            return " ", pick(dig, rng.integers(16, 20)), " "
        if form == 8:
            return " ", "".join(str(w).capitalize() for w in rng.choice(vocab, 3)) + pick(dig, 1), "("
        if form == 9:
            return "integrity ", "sha512-" + pick(b64, 86), "=="
        if form >= 11:
            name = str(rng.choice(["token", "password", "api_key", "secret", "auth", "credential", "TOKEN"]))
            value = [
                lambda: str(rng.choice(["required", "string", "optional", "undefined", "missing", "invalid", "unknown", "hidden", "disabled", "changed", "expired", "number", "getenv", "prompt", "varchar"])),
                lambda: str(rng.choice(vocab)) + str(rng.choice([".", "_", "-"])) + str(rng.choice(vocab)),
                lambda: str(rng.choice(["os.environ", "self.token", "config.secret", "$SECRET_TOKEN", "${PASSWORD}", "request.headers", "args.password", "********", "xxxxxxxx", "..........", "$1_password"])),
                lambda: str(rng.choice(vocab)) + "." if rng.random() < 0.5 else str(rng.choice([w for w in vocab if len(w) > 5])),
            ][rng.integers(4)]()
            return f"{name}{rng.choice(['=', ' = ', ': ', ': '])}", value, ""
        return f'"{rng.choice(["etag", "hash", "version", "build", "fingerprint"])}": "', hx, '"'

    out = []
    for k in range(n):
        before, body, after = good() if k % 2 else bad()
        lead = words(int(rng.integers(0, 6)))
        head = (lead + (" " if lead and before[:1] not in "/ " else "")) + before
        out.append((f"{head}{body}{after} {words(int(rng.integers(0, 6)))}", len(head), len(head) + len(body), k % 2))
    return out


_FOREST: list[Forest] = []


def train(findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (text, start, end, label); of the built-in ones by default."""
    if findings is None:
        if not _FOREST:
            rows = labelled_findings()
            _FOREST.append(grow(np.array([features(t, a, b) for t, a, b, _ in rows], float), np.array([r[3] for r in rows], float)))
        return _FOREST[0]
    own = findings.select("text", "start", "end", "label").dropna()
    n = own.count()
    if n > MAX_FINDINGS:  # about as many, drawn by a hash
        own = own.where(F.pmod(F.xxhash64("text", "start", "end"), F.lit(1_000_003)) < int(1_000_003 * MAX_FINDINGS / n))
    rows = sorted((r["text"], r["start"], r["end"], r["label"]) for r in own.collect())
    return grow(np.array([features(t, a, b) for t, a, b, _ in rows], float), np.array([r[3] for r in rows], float))


def _judged(text: str | None, forest: Forest) -> list[tuple[int, int, str, float]]:
    text = text or ""
    found = find(text)
    if not found:
        return []
    p = forest.predict(np.array([features(text, a, b) for a, b, _ in found], float))
    return [(a, b, kind, round(float(q), 6)) for (a, b, kind), q in zip(found, p, strict=True)]


_SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets and secrets (places in the text, kind, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())  # some ten thousand nodes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, spans = [], []
            for t in b["text"]:
                j = _judged(t, shared.value)
                n.append(len(j))
                spans.append([{"start": a, "end": e, "kind": k, "score": q} for a, e, k, q in j if q >= threshold])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_candidates": n, "n_secrets": [len(s) for s in spans], "secrets": spans})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_candidates long, n_secrets long, secrets {_SPANS}"
    return map_texts(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mask``; the input's columns."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            for a, e, _, q in reversed(_judged(t, shared.value)):
                if q >= threshold:
                    t = t[:a] + mask + t[e:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.select(*[masked(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
