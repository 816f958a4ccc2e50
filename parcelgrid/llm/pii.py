"""Personal data: labelers vote on spans, expectation-maximisation rates them, a classifier makes the final call.

Base spans (e-mail, ip, card, phone) have exact rules and always stay.  Further candidates (secrets, spelled-out e-mail
addresses, national phone numbers, social security numbers, IBANs) come from a wide pattern; regex, gazetteer, context and
check-digit labelers vote on them.
"""
from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "spelled_email", "local_phone", "ssn", "iban")
KINDS = BASE + ADDED
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: from inside the run the outcome would be the same.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WIDE = {
    "secret": re.compile(r"\b(?:AKIA[0-9A-Z]{12,20}|gh[pousr]_[A-Za-z0-9]{20,60}|(?:(?<=[=:])|(?<=[=:] )|(?<=[=:][\"'])|(?<=[=:] [\"']))[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])"),
    "spelled_email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?at ?[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(]? ?dot ?[\])]? ?[A-Za-z]{2,24}\b"),
    "local_phone": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
}
HINT = {"ssn": ("-",), "iban": (), "local_phone": (), "spelled_email": ("dot",), "secret": ("=", ":", "AKIA", "gh")}  # in order of search
GAZETTEER = {
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "key", "credential"),
    "spelled_email": ("mail", "contact", "reach", "write"),
    "local_phone": ("phone", "tel", "call", "mobile", "cell", "fax"),
    "ssn": ("ssn", "social security", "tax id"), "iban": ("iban", "account", "bank"),
}
LABELERS = 4  # shape, gazetteer, context, check; each votes 1, 0 (abstains) or -1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each @ is looked at once, so long runs cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, tuple[int, ...], tuple]]:
    """(kind, start, end, votes, features) of wide matches that touch no base span and no earlier candidate."""
    taken, out = None, []
    for kind, hints in HINT.items():
        if hints and not any(h in text for h in hints):
            continue
        for m in WIDE[kind].finditer(text):
            s, e = m.span()
            if taken is None:
                taken = bytearray(len(text))
                for spans in base.values():
                    for a, b in spans:
                        taken[a:b] = b"\1" * (b - a)
            if any(taken[s:e]):
                continue
            taken[s:e] = b"\1" * (e - s)
            v = votes(kind, text, s, e)
            body = m[0]
            n = len(digits_of(body))
            out.append((kind, s, e, v, (min(4, len(body) // 8), int(4 * n / len(body)), int(any(c.isupper() for c in body)))))
    return out


def votes(kind: str, text: str, s: int, e: int) -> tuple[int, int, int, int]:
    body, before = text[s:e], text[max(0, s - 30):s].lower()
    around = (text[s - 1] if s else " ") + (text[e] if e < len(text) else " ")
    n = len(digits_of(body))
    gazetteer = 1 if any(w in before for w in GAZETTEER[kind]) else 0
    if kind == "secret":
        known = body.startswith(("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"))
        mixed = n >= 2 and any(c.isalpha() for c in body)
        return (1 if known else 0, gazetteer, 1 if around[0] in "=:\"' \n" and mixed else -1, 1 if mixed and entropy(body) > 2.5 else -1)
    if kind == "spelled_email":
        marked = sum(c in "[(" for c in body)
        return (1 if marked >= 2 else -1 if not marked else 0, gazetteer, 1 if marked else -1, 0)
    if kind == "local_phone":
        return (1 if body[0] == "(" else 0, gazetteer, 1 if around[0] in " \n(:" and around[1] in " \n.,;)" else -1,
                -1 if digits_of(body)[0] in "01" else 1)
    if kind == "ssn":
        return (1, gazetteer, 1 if around[0] in " \n(:" else -1, -1 if body[:3] in ("000", "666") or body[0] == "9" or body[4:6] == "00" else 1)
    flat = body.replace(" ", "")
    number = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4]))
    return (1 if 15 <= len(flat) <= 34 else -1, gazetteer, 0, 1 if number % 97 == 1 else -1)


def entropy(s: str) -> float:
    return -sum(p * math.log2(p) for p in (s.count(c) / len(s) for c in set(s)))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that each (kind, votes) is personal data: two-class EM over counts of all patterns, a prior for each kind.

    Each labeler has a distribution of votes for either class, with pseudo-counts that say a vote is right more often
    than not; that fixes which class is which.
    """
    kinds = sorted({p[0] for p in patterns})
    prior = {k: 0.5 for k in kinds}
    table = np.array([[[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]]] * LABELERS)  # labeler, class, vote -1 0 1
    table /= table.sum(axis=2, keepdims=True)
    post: dict = {}
    for _ in range(rounds):
        for kind, v, _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(table[i, 1, x + 1] / table[i, 0, x + 1]) for i, x in enumerate(v))
            post[kind, v] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        counts = np.array([[[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]]] * LABELERS)
        mass = {k: [1.0, 1.0] for k in kinds}
        for kind, v, n in patterns:
            p = post[kind, v]
            mass[kind][0] += n * (1 - p)
            mass[kind][1] += n * p
            for i, x in enumerate(v):
                counts[i, 0, x + 1] += n * (1 - p)
                counts[i, 1, x + 1] += n * p
        table = counts / counts.sum(axis=2, keepdims=True)
        prior = {k: min(0.95, max(0.05, m[1] / sum(m))) for k, m in mass.items()}
    return post


def design(kind: str, v: tuple[int, ...], f: tuple) -> np.ndarray:
    x = [1.0, *(float(kind == k) for k in ADDED), *map(float, v), *(float(abs(y)) for y in v), f[0] / 4, f[1] / 4, float(f[2])]
    return np.array(x)


def classifier(rows: list[tuple[str, tuple[int, ...], tuple, int]], post: dict, rounds: int = 400) -> np.ndarray:
    """Logistic regression on counted patterns with the posteriors as soft labels."""
    sure = [(k, (s,) * LABELERS, (1, 2, 0), y) for k in ADDED for s, y in ((-1, 0.0), (1, 1.0))]  # one made-up pattern for either class
    x = np.stack([design(k, v, f) for k, v, f, _ in [*rows, *sure]])
    y = np.array([*(post[k, v] for k, v, _, _ in rows), *(s[3] for s in sure)])
    n = np.array([*(float(r[3]) for r in rows), *(1.0 for _ in sure)])
    n, w = np.sqrt(n) / np.sqrt(n).sum(), np.zeros(x.shape[1])
    for _ in range(rounds):
        w -= 1.0 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
    return w


def train(docs: DataFrame) -> np.ndarray:
    """Counts vote patterns over all texts (their number is bounded by votes x features) and fits on the counts."""
    def gather(batches):
        for batch in batches:
            seen: dict = {}
            for t in batch.column("text").to_pylist():
                text = t.decode("utf-8", "replace")
                for kind, _, _, v, f in candidates(text, base_spans(text)):
                    seen[kind, v, f] = seen.get((kind, v, f), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([list(k[1]) for k in seen], pa.list_(pa.int32())),
                                              pa.array([list(k[2]) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())],
                                             names=["kind", "votes", "features", "n"])

    rows = (docs.select(bytes_of().alias("text")).mapInArrow(gather, "kind string, votes array<int>, features array<int>, n long")
            .groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect())
    counted = sorted((r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in rows)
    total: dict = {}
    for k, v, _, n in counted:
        total[k, v] = total.get((k, v), 0) + n
    return classifier(counted, reliabilities([(k, v, n) for (k, v), n in total.items()]))


def spans_of(text: str, weights: np.ndarray) -> tuple[dict, list[tuple[str, int, int]]]:
    base = base_spans(text)
    spans = [(k, s, e) for k in BASE for s, e in base[k]]
    more = [(k, s, e) for k, s, e, v, f in candidates(text, base) if design(k, v, f) @ weights > 0]
    return base, spans + sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """A row for each document: counts of base kinds, hash of base spans, and all spans.

    Null and empty texts have none; rows with equal or null ids are rows of their own; a span within another of a different
    base kind counts for both, added spans touch no other; columns beside doc_id and text are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                base, spans = spans_of(t.decode("utf-8", "replace"), shared.value)
                own = written([x for x in spans if x[0] in BASE])
                rows.append((*(len(base[k]) for k in BASE), hashlib.sha256(own.encode()).hexdigest(), written(spans)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return (docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
            .mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))


def masked(text: str, spans) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts and covers all."""
    out, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        e = -e
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with all its columns and rows, repeated ones too, personal data in `text` replaced by its kind; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def mask(text):
        return text.map(lambda t: t if t is None else masked(t, spans_of(t, shared.value)[1]))

    return docs.withColumn("text", mask("text"))
