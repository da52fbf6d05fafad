"""Operator 1: personal data by weak supervision.

Base spans come from four patterns with a check each (fixed by the contract) and are always kept. Besides, candidate spans of
credentials and of contact or account numbers in other shapes are gathered, and labelers vote on each: expressions for its shape, a gazetteer of known
prefixes and field names, and its context, which is the words before it, plus checks of digits and of letter variety. Each votes for, against, or not.
Expectation-maximisation over the counts of all vote patterns in the corpus estimates each labeler's hit and false-alarm rates and
how likely each pattern is to be personal data. A logistic span classifier is then trained on these soft labels, from
votes and shape together, and decides on every candidate.

Texts are read once. What is counted are patterns (votes and shape), of which there is a fixed number, so the
driver's part is bounded whatever the corpus. Labelers are assumed independent given the truth, as usual for this model.

Defined cases: a null text is the empty text and has no spans. Positions are code points, ends exclusive. Repeated rows give equal results.
A candidate that overlaps a base span is dropped; all others are judged, and of overlapping accepted ones the one that starts first stays, the longer one on ties.
Scanning takes linear time on any text.
Without candidates nothing is trained. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import common, words

#: Fixed by the contract: kind -> pattern, in the order in which spans are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches by scans that enter a run of characters at its start only, so that no text takes more than linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_FIRST, _EMAIL_HERE = re.compile(rf"(?<!{_LOCAL}){_EMAIL}"), re.compile(_EMAIL)
_SCANS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": BASE["phone"],
}
#: What the method may add, in the order in which it is listed after the base kinds.
MORE = ("account", "contact", "credential")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^0-9]+")
_SIGN = re.compile(r"[=:]")
_CANDIDATES = (
    ("credential", re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])")),
    ("credential", re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{3,}+ ?[=:] ?\"?[A-Za-z0-9_/+.-]{8,}+\"?")),
    ("credential", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{24,}+(?![A-Za-z0-9])")),
    ("contact", re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")),
    ("contact", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)+")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])")),
)
#: Gazetteers: field names, known prefixes of credentials, and context words of each kind.
FIELDS = {"password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "key", "auth", "bearer", "credential", "login"}
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk_", "pk_", "eyJ", "AIza")
CONTEXT = {
    "credential": FIELDS | {"access", "passphrase", "pin"},
    "contact": {"call", "phone", "tel", "mobile", "fax", "contact", "reach", "mail", "email"},
    "account": {"ssn", "social", "iban", "account", "passport", "id", "tax"},
}
LABELERS = ("shape", "gazetteer", "context", "digits", "variety", "length")
PATTERN = 3 ** len(LABELERS)
SHAPES = 64


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _fits(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in found.split("."))
    if kind in ("card", "phone"):
        digits = _OTHER.sub("", found)
        return 13 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[re.Match]:
    """All matches from left to right; one may begin where the last has ended, within a run of characters."""
    m = _EMAIL_FIRST.search(text) if "@" in text else None
    while m:
        yield m
        m = _EMAIL_HERE.match(text, m.end()) or _EMAIL_FIRST.search(text, m.end())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out = [("email", m.start(), m.end()) for m in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in _SCANS.items():
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return out


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote a labeler: 2 for, 1 against, 0 none."""
    found = text[start:end]
    before = re.findall(r"[a-z_]+", text[max(0, start - 40) : start].lower())[-3:]
    value = re.split(r"[=:]", found)[-1].strip(' "')
    field = re.split(r"[=:]", found)[0].strip().lower() if re.search(r"[=:]", found) else ""
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    share = digits / max(1, len(value))
    shape = 2 if (kind == "credential" and re.fullmatch(r"[A-Z0-9]{16,}|[0-9a-f]{16,}", value) and digits and letters) or (kind != "credential" and digits >= 9) or "at)" in found or "at]" in found else 1 if not digits else 0
    gazetteer = 2 if field in FIELDS or value.startswith(PREFIXES) else 1 if field else 0
    context = 2 if CONTEXT[kind].intersection(before) else 0
    mixed = 2 if 0.1 <= share <= 0.9 and letters else 1 if kind == "credential" and (not digits or not letters) else 2 if kind != "credential" and digits >= 7 else 0
    distinct = len(set(value)) / max(1, len(value))
    variety = 2 if len(set(value)) >= 8 else 1 if distinct < 0.25 or len(set(value)) <= 3 else 0
    length = 2 if len(value) >= 16 else 0 if len(value) >= 9 else 1
    return shape, gazetteer, context, mixed, variety, length


def _shape(kind: str, found: str) -> int:
    """A small code of a candidate's shape: kind, length class, separators."""
    return (MORE.index(kind) * 4 + min(3, len(found) // 16)) * 4 + 2 * ("=" in found or ":" in found) + (" " in found)


def _matches(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of all candidate patterns; a field's value may begin with a field of its own."""
    number = _DIGIT.search(text)
    for kind, pattern in _CANDIDATES:
        if (kind == "account" and not number) or (kind == "contact" and not number and "(at)" not in text and "[at]" not in text):
            continue
        m = pattern.search(text)
        while m:
            yield m.start(), m.end(), kind
            sign = _SIGN.search(m[0]) if kind == "credential" else None
            m = pattern.search(text, m.start() + sign.end() if sign else m.end())


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, pattern) of spans outside the base ones, by start, longer ones first; the pattern packs votes and shape."""
    found = sorted({(start, -end, kind) for start, end, kind in _matches(text)})
    busy = sorted((s, e) for _, s, e in taken)
    out, i = [], 0
    for start, end, kind in found:
        end = -end
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        if any(s < end for s, _ in busy[i : i + 1]):
            continue
        code = 0
        for v in _votes(kind, text, start, end):
            code = 3 * code + v
        out.append((kind, start, end, code * SHAPES + _shape(kind, text[start:end])))
    return out


_ROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("base", pa.string()), ("candidates", pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("pattern", pa.int64())])))])
_KEPT = ("doc_id", *(f"n_{k}" for k in BASE), "base_sha256")
_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, candidates array<struct<kind:string,s:long,e:long,pattern:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in words.groups(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = base_spans(text)
            joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            row = {"doc_id": doc, "base": joined, "base_sha256": hashlib.sha256(joined.encode()).hexdigest()}
            row |= {f"n_{k}": sum(b[0] == k for b in base) for k in BASE}
            row["candidates"] = [{"kind": k, "s": s, "e": e, "pattern": p} for k, s, e, p in candidates(text, base)]
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def _unpack(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (patterns x labelers) and shapes."""
    code, shape = patterns // SHAPES, patterns % SHAPES
    votes = np.stack([code // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], axis=1)
    return votes, shape


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: each pattern's probability of being personal data, and the labelers' vote rates (class x labeler x vote)."""
    k = votes.shape[1]
    for_, against = (votes == 2).sum(axis=1), (votes == 1).sum(axis=1)
    p = (for_ + 1) / (for_ + against + 2)
    rates = np.full((2, k, 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in ((0, (1 - p) * counts), (1, p * counts)):
            for j in range(k):
                # a little prior knowledge: votes agree with the truth more often than not
                prior = np.array([1.0, 1.0, 2.0]) if c else np.array([1.0, 2.0, 1.0])
                seen = np.bincount(votes[:, j], weights=weight, minlength=3) + prior
                rates[c, j] = seen / seen.sum()
        prior_1 = ((p * counts).sum() + 1) / (counts.sum() + 2)
        log = [np.log(q) + np.log(rates[c][np.arange(k)[None, :], votes]).sum(axis=1) for c, q in ((0, 1 - prior_1), (1, prior_1))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, rates


def classifier(votes: np.ndarray, shape: np.ndarray, counts: np.ndarray, soft: np.ndarray, steps: int = 300) -> np.ndarray:
    """A logistic regression on one-hot votes and shapes, weighted by counts, on soft labels: each pattern's probability."""
    x = np.zeros((len(votes), 3 * len(LABELERS) + SHAPES + 1))
    for j in range(len(LABELERS)):
        x[np.arange(len(votes)), 3 * j + votes[:, j]] = 1
    x[np.arange(len(votes)), 3 * len(LABELERS) + shape] = 1
    x[:, -1] = 1
    weight = counts / counts.sum()
    w, heat = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - soft)) + 1e-4 * w
        heat += slope * slope
        w -= 0.5 * slope / np.sqrt(heat)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def accepted_patterns(counted: list[tuple[int, int]]) -> list[int]:
    """Patterns that the trained span classifier takes, from (pattern, count) of the whole corpus."""
    if not counted:
        return []
    patterns, counts = (np.array(c, np.int64) for c in zip(*sorted(counted), strict=True))
    votes, shape = _unpack(patterns)
    soft, _ = estimate(votes, counts.astype(float))
    p = classifier(votes, shape, counts.astype(float), soft)
    return [int(x) for x in patterns[p >= 0.5]]


def _judged(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, list[int]]:
    common.short_batches(spark)
    rows = common.texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    found = common.stage(rows.mapInArrow(_scan, _SCHEMA), "spans")
    counted = found.select(F.explode("candidates.pattern").alias("pattern")).groupBy("pattern").count().collect()  # PATTERN * SHAPES rows at most
    return found, accepted_patterns([(r["pattern"], r["count"]) for r in counted])


def _listed(accepted: frozenset[int]):
    """Each row's spans: the base ones, then the accepted candidates that overlap none before them, by kind and start."""
    schema = pa.schema([*((f, _ROW.field(f).type) for f in _KEPT), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in (*MORE, "added", "spans"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                chosen: dict[str, list[str]] = {k: [] for k in MORE}
                reach = 0
                for c in found:
                    if c["pattern"] in accepted and c["s"] >= reach:
                        reach = c["e"]
                        chosen[c["kind"]].append(f"{c['kind']}:{c['s']}:{c['e']}")
                added = [x for k in MORE for x in chosen[k]]
                every = ([base] if base else []) + added
                rows.append((",".join(every), *(len(chosen[k]) for k in MORE), len(added), len(added) + (base.count(",") + 1 if base else 0)))
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types[len(_KEPT) :])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in _KEPT), *new], schema=schema)

    return run


def find(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as one string, and how many the method adds, by kind and in all."""
    found, accepted = _judged(spark, documents)
    counts = ", ".join(f"n_{k} long" for k in (*MORE, "added", "spans"))
    return found.mapInArrow(_listed(frozenset(accepted)), f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, {counts}")


def masked(text: str, accepted: frozenset[int]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    base = base_spans(text)
    chosen, reach = [], 0
    for k, s, e, p in candidates(text, base):
        if p in accepted and s >= reach:
            chosen.append((s, e, k))
            reach = e
    spans = sorted([(s, e, k) for k, s, e in base] + chosen)
    out, at = [], 0
    for s, e, kind in spans:
        if s < at:  # overlapping base spans: the rest of the later one goes with the earlier
            at = max(at, e)
            continue
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text``; all columns and rows are kept, a null text stays null."""
    found, accepted = _judged(spark, documents)
    common.drop(found)
    chosen = frozenset(accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            new = [None if t is None else masked(t, chosen) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    return documents.mapInArrow(run, documents.schema)
