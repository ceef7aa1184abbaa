"""Personal data by weak supervision.

Candidates.  The base patterns (email, ip, card, phone: leftmost, not
overlapping within a kind, checked, no retries) are spans whatever the model
says.  Further candidates come from wider patterns: the base ones that failed
their check, phone numbers without a plus, spelled-out addresses ("ann at host
dot com"), account and social-security shapes, capitalised words after a given
name, and secrets: what is assigned to a secret's name, keys of a known prefix,
and long runs of hexadecimal digits.

Votes.  Regex labelers (shape, check sum), gazetteer labelers (host endings,
card issuers, given names) and context labelers (cue words before, counter cues
before, what touches the span) each vote yes, no or nothing.

Model.  Votes only matter as patterns, and there are few: the executors count
patterns per kind over all documents, and expectation-maximisation estimates on
these counts, per kind, how each labeler votes on true and on false spans, and
the share of true ones (a prior stands in where there are few votes).
The posteriors then train the final span classifier, a logistic model of the
votes with the kinds' own intercepts, on the same counts.  A further candidate
becomes a span if the classifier gives at least ``ACCEPT`` and it touches no
base span.

Null text is an empty text: no spans.  Every row has its own result, so repeated
rows and null ids are fine; an empty table gives no rows (and a model that
accepts nothing); extra columns are ignored, and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.shared import stage

KINDS = ["email", "ip", "card", "phone", "account", "ssn", "name", "secret"]
ACCEPT, CONTEXT = 0.9, 40
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where its digits do and gives none back, so long runs of digits are passed once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\bat\b|\(at\)|\[at\]) ?[A-Za-z0-9-]+ ?(?:\bdot\b|\(dot\)|\[dot\]) ?[A-Za-z]{2,}\b")
_PLAIN_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_ASSIGNED = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([^\s\"',;]{6,200})")
_LONG_RUN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[A-Z0-9]{20}|(?:sk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,100})(?![A-Za-z0-9])")
#: What keys of well-known services begin with.
KEY_STARTS = ["AKIA", "ASIA", "ghp_", "sk-", "sk_", "xoxb-"]
#: Given names of the gazetteer, cue and counter-cue words, and host endings.
GIVEN = ["Alice", "Anna", "Carlos", "Charles", "David", "Elena", "Elizabeth", "Emma", "Hans", "James", "Jean", "Jennifer", "John", "José", "Juan", "Klaus", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary", "Michael", "Patricia", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Susan", "Thomas", "William"]
CUES = {
    "email": ["email", "e-mail", "mail", "contact", "write", "reach", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "login", "logged", "adresse"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"],
    "account": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social", "security"],
    "name": ["name", "mr", "mrs", "ms", "dr", "dear", "named", "signed", "monsieur", "madame", "herr", "frau", "señor", "señora"],
    "secret": ["password", "passwd", "pwd", "secret", "token", "key", "apikey", "credential", "credentials"],
}
COUNTER = ["version", "release", "isbn", "order", "invoice", "section", "chapter", "build", "sku", "page", "figure", "table", "part", "serial", "rfc", "commit", "checksum", "digest", "hash"]
ENDINGS = ["com", "org", "net", "edu", "gov", "io", "info", "co", "uk", "de", "fr", "es", "eu", "us", "ca"]
_NAME = re.compile(r"\b(?:" + "|".join(map(re.escape, GIVEN)) + r") [A-ZÀ-Þ][a-zà-ÿ]+\b")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Prior chances of a labeler's votes (-1, 0, 1) on a true and on a false span, and what they weigh in observations.
PRIORS = {
    "shape": ([0.05, 0.25, 0.70], [0.30, 0.40, 0.30]),
    "check": ([0.02, 0.08, 0.90], [0.80, 0.10, 0.10]),
    "gazetteer": ([0.10, 0.30, 0.60], [0.40, 0.40, 0.20]),
    "cue": ([0.01, 0.59, 0.40], [0.01, 0.95, 0.04]),
    "counter": ([0.02, 0.96, 0.02], [0.25, 0.73, 0.02]),
    "touch": ([0.03, 0.95, 0.02], [0.40, 0.58, 0.02]),
}
PRIOR_WEIGHT = 30
_LABELERS = ["shape", "check", "gazetteer", "cue", "counter", "touch"]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the base pattern, found from each at-sign outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans ``(start, kind, end)`` in contract order, and matches of digits that failed their check."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    failed = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
            (spans if ok else failed).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19:
                    (spans if luhn(d) else failed).append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_DIGIT.findall(m[0]))
                (spans if 9 <= n <= 15 else failed).append((m.start(), 3, m.end()))
    name = lambda rows: [(s, KINDS[k], e) for s, k, e in sorted(rows)]
    return name(spans), name(failed)


def _further(text: str, failed: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    out = list(failed)
    if _DIGIT.search(text):
        out += [(m.start(), k, m.end()) for k, p in (("phone", _PLAIN_PHONE), ("ssn", _SSN), ("account", _ACCOUNT)) for m in p.finditer(text)]
    out += [(m.start(), "secret", m.end()) for m in _LONG_RUN.finditer(text)]
    if "dot " in text or "(dot)" in text or "[dot]" in text:
        out += [(m.start(), "email", m.end()) for m in _SPELLED.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), "secret", m.end(1)) for m in _ASSIGNED.finditer(text)]
    if any(n in text for n in GIVEN):
        out += [(m.start(), "name", m.end()) for m in _NAME.finditer(text)]
    return sorted(set(out))


def _check(kind: str, span: str) -> int:
    digits = "".join(_DIGIT.findall(span))
    if kind == "card":
        return 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "ip":
        return 1 if all(p.isdigit() and int(p) <= 255 for p in span.split(".")) else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 else -1
    if kind == "ssn":
        return -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    if kind == "account":
        s = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == "secret":
        return 1 if len(set(span)) >= 8 and digits and len(digits) < len(span) else -1
    return 0


def votes(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """The labelers' votes on a span: 1, -1, or 0 for none."""
    span = text[start:end]
    digits = "".join(_DIGIT.findall(span))
    before = [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])]
    shape = {
        "email": 1 if "@" in span else 0,
        "ip": 1 if all(len(p) <= 3 for p in span.split(".")) else -1,
        "card": 1 if len(digits) in (13, 15, 16) else 0,
        "phone": 1 if span[0] in "+(" or span.count("-") >= 2 else 0,
        "secret": 1 if _LONG_RUN.fullmatch(span) else 0,
    }.get(kind, 1)
    if kind == "email":
        known = 1 if span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in ENDINGS else 0
    elif kind == "card":
        known = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        known = 1 if span[0] == "+" and digits[0] != "0" else 0
    elif kind == "secret":
        known = 1 if span.startswith(tuple(KEY_STARTS)) else 0
    elif kind == "name":
        known = 1
    else:
        known = 0
    cue = 1 if any(w in CUES[kind] for w in before[-5:]) else 0
    counter = -1 if any(w in COUNTER for w in before[-3:]) else 0
    touched = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_@")) or (end < len(text) and (text[end].isalnum() or text[end] in "_@"))
    return shape, _check(kind, span), known, cue, counter, -1 if touched else 0


def _code(kind: str, v: tuple[int, ...]) -> int:
    out = KINDS.index(kind)
    for x in v:
        out = out * 3 + x + 1
    return out


def _decode(code: int) -> tuple[int, np.ndarray]:
    v = []
    for _ in _LABELERS:
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code, np.array(v[::-1])


def find(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, int]], list[int]]:
    """Base spans, further candidates with their vote codes, and the vote codes of the base spans."""
    text = text or ""
    base, failed = base_spans(text)
    starts = [s for s, _, _ in base]
    far = max((e - s for s, _, e in base), default=0)
    more = []
    for s, k, e in _further(text, failed):
        near = base[bisect_left(starts, s - far) : bisect_left(starts, e)]
        if not any(b < e and s < x for b, _, x in near):
            more.append((s, k, e, _code(k, votes(text, s, k, e))))
    return base, more, [_code(k, votes(text, s, k, e)) for s, k, e in base]


@dataclass(frozen=True)
class Model:
    """Labelers' reliabilities by kind, the classifier's weights, and the vote codes that it accepts."""

    reliability: dict[str, list[float]]
    weights: list[float]
    accepted: frozenset[int]


def fit(counts: dict[int, int], rounds: int = 50, accept: float = ACCEPT) -> Model:
    """EM on counted vote patterns, then the classifier on their posteriors."""
    if not counts:
        return Model({}, [], frozenset())
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kind = np.array([_decode(c)[0] for c in codes])
    v = np.stack([_decode(c)[1] for c in codes])
    # start: the balance of the votes
    q = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
    reliability: dict[str, list[float]] = {}
    for k in np.unique(kind):
        at = kind == k
        w, x = n[at], v[at]
        for _ in range(rounds):
            truth = {1: q[at], 0: 1 - q[at]}
            odds = np.full(at.sum(), np.log((w @ truth[1] + 1) / (w @ truth[0] + 1)))
            right = []
            for j, name in enumerate(_LABELERS):
                # chances of a vote of -1, 0 and 1 given true and given false, under the prior
                chance = {y: np.array([w @ (truth[y] * (x[:, j] == z)) + PRIOR_WEIGHT * PRIORS[name][1 - y][z + 1] for z in (-1, 0, 1)]) for y in (1, 0)}
                right.append(float((chance[1][2] + chance[0][0]) / (chance[1][[0, 2]].sum() + chance[0][[0, 2]].sum())))
                odds += (np.log(chance[1] / chance[1].sum()) - np.log(chance[0] / chance[0].sum()))[x[:, j] + 1]
            q[at] = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        reliability[KINDS[int(k)]] = right
    # logistic regression by Newton steps with a ridge, each pattern weighted by how often it occurs (log-damped)
    features = np.concatenate([v > 0, v < 0, np.eye(len(KINDS))[kind]], axis=1).astype(float)
    w, beta = np.log1p(n), np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        grad = features.T @ (w * (q - p)) - 0.1 * beta
        hess = features.T @ (features * (w * p * (1 - p))[:, None]) + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
    return Model(reliability, beta.tolist(), frozenset(c for c, x in zip(codes, p, strict=True) if x >= accept))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<s:int,k:string,e:int>>, more array<struct<s:int,k:string,e:int,c:int>>, codes array<struct<c:int,n:int>>"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.doc_id, b.text, strict=True):
            base, more, codes = find(text)
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
            each: dict[int, int] = {}
            for c in [*codes, *(c for *_, c in more)]:
                each[c] = each.get(c, 0) + 1
            rows.append((None if pd.isna(doc_id) else int(doc_id), *(kinds.count(k) for k in KINDS[:4]), digest, [{"s": s, "k": k, "e": e} for s, k, e in base], [{"s": s, "k": k, "e": e, "c": c} for s, k, e, c in more], [{"c": c, "n": n} for c, n in each.items()]))
        yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "more", "codes"]).astype({"doc_id": "Int64"})


def candidates(docs: DataFrame) -> DataFrame:
    """Per document row its base spans, further candidates and counted vote codes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_found, _FOUND)


def train(found: DataFrame) -> Model:
    """The model from the vote patterns of all documents; at most 8 * 3^6 counts reach the driver."""
    counts = found.select(F.explode("codes").alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("n")).collect()
    return fit({r["c"]: r["n"] for r in counts})


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` per row of ``docs``."""
    found = stage(candidates(docs), "pii-candidates")
    accepted = train(found).accepted
    added = F.filter("more", lambda m: m["c"].isin(list(accepted)) if accepted else F.lit(False))
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), rank(x["k"]).alias("r"), x["k"].alias("k"), x["e"].alias("e")))
    spans = F.array_sort(F.concat(keyed(F.col("base")), keyed(added)))
    text = F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size(added).cast("long").alias("n_added"))


def masked(text: str | None, accepted: frozenset[int]) -> str | None:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    if text is None:
        return None
    base, more, _ = find(text)
    spans = sorted([*base, *((s, k, e) for s, k, e, c in more if c in accepted)])
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, where present, brought in line."""
    accepted = train(stage(candidates(docs).select("codes"), "pii-votes")).accepted

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        return pd.Series([masked(t, accepted) for t in text], dtype=object)

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
