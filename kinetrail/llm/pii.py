r"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always count. Further candidates,
opaque strings that may be secrets and numbers written like social security numbers, get votes
of three labelers: a shape rule, a gazetteer of key names and issued prefixes, and a context
rule over the words before. Expectation-maximisation over all candidates of the corpus
estimates each labeler's reliabilities and every candidate's posterior (Dawid and Skene 1979);
a logistic span classifier over votes and surface features is trained on the posteriors and
decides. Votes and features are few-valued: a candidate is a code below 2^12, the corpus comes
to the driver as a count for each code, and both fits are exact over all candidates.

A null doc_id stays null, and null texts are empty: no spans. Offsets are code points, ends exclusive. Repeated rows each get
their spans; candidates of both count. Added spans that touch a base span are dropped. With no
candidates no model is needed and only base spans remain.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # no match can begin within a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])")
LETTER = re.compile("[A-Za-z]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Gazetteers: names of keys, prefixes of issued keys, words that announce private values. Fixed values.
KEY_NAMES = re.compile(r"(?:token|password|passwd|pwd|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|ssn|social security(?: number)?)\s*(?:is|=|:)*\s*[\"']?$", re.I)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza")
CONTEXT = re.compile(r"\b(?:token|password|passwd|pwd|secret|key|credential|login|auth|bearer|ssn|social|security|private|confidential)\b", re.I)
BEFORE = 40
THRESHOLD = 0.5
CODES = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the characters before it back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of strings the labelers vote on; none touches a base span.

    A number inside an opaque string is a candidate of its own; masking unites what overlaps.
    """
    # Ends of base spans up to each start, so that spans that reach far are seen by bisection.
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    out = []
    for kind, pattern in ((4, OPAQUE), (5, SSN)):
        for m in pattern.finditer(text):
            value, before = m[0], text[max(0, m.start() - BEFORE) : m.start()]
            if kind == 4 and not LETTER.search(value):
                continue
            k = bisect_left(starts, m.end())
            if k and reach[k - 1] > m.start():
                continue
            out.append((m.start(), kind, m.end(), _code(kind, value, before)))
    return sorted(out)


def _code(kind: int, value: str, before: str) -> int:
    """Votes (0 against, 1 for, 2 none) of shape, gazetteer and context, and surface features, as a number."""
    if kind == 4:
        kinds = len(set(value))
        mixed = [bool(re.search(c, value)) for c in ("[0-9]", "[a-z]", "[A-Z]")]
        if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", value) or (kinds >= 12 and mixed[1] and mixed[2]):
            shape = 1
        else:  # letters of one case may be a long word
            shape = 0 if kinds < 8 or sum(mixed) == 1 else 2
    else:
        shape = 0 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    named = 1 if KEY_NAMES.search(before) or value.startswith(PREFIXES) else 2
    context = 1 if CONTEXT.search(before) else 0
    size = min(len(value) // 16, 3)
    digits = 4 * sum("0" <= c <= "9" for c in value) // (len(value) + 1)
    quoted = before[-1:] in ("'", '"')
    return ((((kind - 4) * 3 + shape) * 3 + named) * 3 + context) * 32 + size * 8 + digits * 2 + quoted


def _votes(codes: np.ndarray) -> np.ndarray:
    v = codes // 32
    return np.stack([v // 9 % 3, v // 3 % 3, v % 3], 1)


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50, smoothing: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """EM from majority votes: (posterior of each code, table [labeler, true class, vote])."""
    votes = _votes(codes)
    posterior = np.clip(0.5 + ((votes == 1).sum(1) - (votes == 0).sum(1)) / 6, 0.05, 0.95)
    table = np.zeros((3, 2, 3))
    for _ in range(rounds):
        by_class = np.stack([1 - posterior, posterior], 1) * counts[:, None]
        prior = (by_class.sum(0) + smoothing) / (by_class.sum() + 2 * smoothing)
        for k in range(3):
            # A labeler is taken to be better than chance: pseudo-votes say so.
            table[k] = [[2 * smoothing, smoothing, smoothing], [smoothing, 2 * smoothing, smoothing]]
            for vote in range(3):
                table[k, :, vote] += by_class[votes[:, k] == vote].sum(0)
        table /= table.sum(2, keepdims=True)
        log = np.log(prior) + sum(np.log(table[k][:, votes[:, k]]).T for k in range(3))
        new = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return posterior, table


def _features(codes: np.ndarray) -> np.ndarray:
    votes = _votes(codes)
    hot = [(votes[:, k] == v) for k in range(3) for v in (0, 1)]
    rest = codes % 32
    parts = [np.ones(len(codes)), codes // (32 * 27), *hot, rest // 8 / 3, rest // 2 % 4 / 3, rest % 2]
    return np.stack(parts, 1).astype(float)


def accepted(counted: dict[int, int], threshold: float = THRESHOLD, ridge: float = 1.0) -> list[int]:
    """Codes that the classifier calls private; fitted by Newton steps on the posteriors, a weight for each code's count."""
    if not counted:
        return []
    codes = np.array(sorted(counted))
    counts = np.array([counted[c] for c in codes], float)
    target, _ = reliabilities(codes, counts)
    x = _features(codes)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (target - p)) - ridge * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return codes[1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) >= threshold].tolist()


def _spans(texts: pd.Series) -> pd.DataFrame:
    base = [base_spans(t or "") for t in texts]
    more = [candidates(t or "", b) for t, b in zip(texts, base, strict=True)]
    return pd.DataFrame(
        {
            "base": [[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base],
            "more": [[{"start": a, "kind": k, "end": b, "code": c} for a, k, b, c in x] for x in more],
        }
    )


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): base spans and candidates of every document."""
    spans = F.pandas_udf(_spans, "base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,kind:int,end:int,code:int>>")
    return docs.select("doc_id", spans("text").alias("s")).select("doc_id", "s.base", "s.more")


def learned(spans: DataFrame) -> list[int]:
    """Accepted codes from all candidates; at most CODES counts come to the driver."""
    counted = spans.select(F.explode("more.code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return accepted({r["code"]: r["n"] for r in counted.collect()})


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every document."""
    spans = written(found(docs))
    codes = F.array(*map(F.lit, learned(spans))).cast("array<int>")
    added = F.transform(F.filter("more", lambda s: F.array_contains(codes, s["code"])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.array_sort(F.concat(F.col("base"), added))
    n = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return spans.select("doc_id", *n, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(every).alias("spans"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets."""
    codes = set(learned(written(found(docs))))

    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(one)

    def one(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted(base + [(a, k, b) for a, k, b, c in candidates(text, base) if c in codes])
        out, at = [], 0
        for a, k, b in spans:
            if b > at:
                out.append(text[at : max(a, at)] + f"[{KINDS[k].upper()}]")
                at = b
        return "".join(out) + text[at:] if spans else text

    return docs.withColumn("text", F.pandas_udf(mask, "string")(F.col("text")))
