"""Personal data by weak supervision.

Candidate spans come from exact base rules (email, ip, card, phone) and from
loose rules of further kinds (secret, iban, ssn, and name: any two or three capitalised words).  Labelers of three sorts
vote on every candidate or abstain: strict patterns and checksums, gazetteers,
and the words around it.  Expectation-maximisation over the counts of all vote
patterns of the corpus estimates how reliable each labeler is for each kind, and
its posteriors train a logistic span classifier.  Base spans always stay; of the
further kinds those that the classifier accepts are added.

Vote patterns are at most kinds x 3^labelers x lengths; only their counts reach
the driver, whatever the size of the corpus.

Defined results: a null text counts as empty and has no spans; very long texts and numbers are
read whole, in time that grows with their length; positions are code points, ends exclusive; a null id or a repeated row is passed on as it is;
an empty table gives an empty result.  Spans that the method adds never overlap base ones, which always stay; candidates with equal votes are decided
alike.  Other columns than the id and the text, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.storage import materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "name", "secret", "ssn")
KINDS = BASE + ADDED
LABELERS = ("pattern", "gazetteer", "context", "shape")
ACCEPT = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit inside a run never opens a match that the run's first digit did not open.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NON_DIGIT = re.compile(r"[^0-9]")
OPENING = re.compile(r"(?:\A|[.!?:\n])\s*\Z")

ASSIGNED = re.compile(r"""[=:][\x20\t]{0,3}["']?([^\s"',;]{8,})""")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NAME = re.compile(r"(?<!\w)[A-ZÀ-Þ][a-zß-ÿ]+\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?(?!\w)")

# Word lists of the gazetteer and context labelers.
SECRET_WORDS = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)[\"']?\Z")
GIVEN_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas "
    "Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna Hans Peter "
    "Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Stefan Jean Pierre Michel Marie Nathalie Isabelle Sylvie François Jacques "
    "Antonio José Manuel Francisco Carmen María Dolores Pilar Luis Javier Ana Laura Anna Alice Emma".split()
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora Sr Sra".split())
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu ch at it nl be se no dk pl ru jp cn in br ca au".split())
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax id)\b"),
    "name": re.compile(r"(?i)\b(?:name|named|signed|dear|regards|sincerely|born|nombre|nom|heißt)\b"),
    "secret": re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|key|auth|credential|bearer)"),
}
#: Parameter: code points before a span in which context words count.
WINDOW = 40
#: Code points that the longest of SECRET_WORDS and a quote take up.
SECRET_REACH = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from their @ in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        elif start == at:
            pass
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base rules by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NON_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NON_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def further_spans(text: str) -> list[tuple[str, int, int]]:
    """Loose candidates of the kinds that the base rules do not know, by kind, then start."""
    found: set[tuple[str, int, int]] = set()
    if "=" in text or ":" in text:
        for m in ASSIGNED.finditer(text):
            at = m.start()
            while at and text[at - 1].isspace():
                at -= 1
            if SECRET_WORDS.search(text[max(0, at - SECRET_REACH) : at]):
                found.add(("secret", m.start(1), m.end(1)))
    for m in TOKEN.finditer(text):
        s = m[0]
        if not s.isalpha() and not s.isdigit() and any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            found.add(("secret", m.start(), m.end()))
    for m in IBAN.finditer(text):
        found.add(("iban", m.start(), m.end()))
    for m in SSN.finditer(text):
        found.add(("ssn", m.start(), m.end()))
    for m in NAME.finditer(text):
        found.add(("name", m.start(), m.end()))
    return sorted(found)


def _pattern(kind: str, s: str) -> int:
    """1 valid, 0 not, by a strict rule; -1 where there is none."""
    if kind == "iban":
        flat = s.replace(" ", "")
        return int(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
    if kind == "ssn":
        return int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    if kind == "secret":
        strict = re.fullmatch(r"AKIA[0-9A-Z]{16}|[0-9a-f]{16,64}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,}", s)
        return 1 if strict else -1
    return -1 if kind == "name" else 1


def _gazetteer(kind: str, s: str) -> int:
    if kind == "email":
        return int(s.rsplit(".", 1)[1].lower() in TOP_DOMAINS)
    if kind == "ip":
        return int(s.split(".")[0].lstrip("0") not in ("", "127"))
    if kind == "name":
        first = s.split(" ")[0].rstrip(".")
        return int(first in GIVEN_NAMES or first in TITLES)
    if kind == "card":
        return int(s[0] in "3456")
    return -1


def _context(kind: str, before: str) -> int:
    """1 if a word before the span says what it is; for a name, 0 if it opens a sentence, where any word is capitalised."""
    if CONTEXT[kind].search(before):
        return 1
    return 0 if kind == "name" and OPENING.search(before) else -1


def _shape(kind: str, s: str) -> int:
    """Whether characters are mixed as in machine-made strings, or names as in prose."""
    if kind == "secret":
        digits = sum(c.isdigit() for c in s)
        return int(digits >= 3 and len(set(s)) >= 8 and "://" not in s and s.count("-") <= 4)
    if kind == "card":
        return int(len(set(s)) >= 4)
    if kind == "phone":
        return int(len(set(NON_DIGIT.sub("", s))) >= 3)
    return -1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, int, int, int]:
    s = text[start:end]
    return _pattern(kind, s), _gazetteer(kind, s), _context(kind, text[max(0, start - WINDOW) : start]), _shape(kind, s)


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, vote pattern) of all candidates; further ones never overlap base ones."""
    base = base_spans(text)
    starts, ends = _union(base)

    def free(a: int, b: int) -> bool:
        at = bisect_left(ends, a + 1)  # the first stretch that ends after a
        return at == len(ends) or starts[at] >= b

    further = [(k, a, b) for k, a, b in further_spans(text) if free(a, b)]
    out = []
    for is_base, spans in ((True, base), (False, further)):
        for k, a, b in spans:
            v = votes(k, text, a, b)
            out.append((k, a, b, is_base, f"{k}|{','.join(map(str, v))}|{min(5, (b - a) // 8)}"))
    return out


def _parse(pattern: str) -> tuple[str, list[int], int]:
    kind, v, length = pattern.split("|")
    return kind, [int(x) for x in v.split(",")], int(length)


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior that a candidate is personal data, per vote pattern, by EM over pattern counts.

    Per kind and labeler the chances of a positive vote for true and for false
    candidates are estimated; abstentions say nothing.  Starts from the share of
    positive votes and smooths with one vote of either sort.
    """
    posterior: dict[str, float] = {}
    for kind in KINDS:
        own = [(p, n, _parse(p)[1]) for p, n in sorted(patterns.items()) if p.startswith(kind + "|")]
        if not own:
            continue
        n = np.array([x[1] for x in own], float)
        v = np.array([x[2] for x in own])
        cast = v >= 0
        q = np.where(cast.any(1), (0.5 + (v == 1).sum(1)) / (1 + np.maximum(cast.sum(1), 1)), 0.5)
        for _ in range(rounds):
            w1, w0 = n * q, n * (1 - q)
            prior = (w1.sum() + 1) / (n.sum() + 2)
            yes = (w1 @ (v == 1) + 4) / (w1 @ cast + 5)  # beliefs before any votes: 0.8 and 0.2
            no = (w0 @ (v == 1) + 1) / (w0 @ cast + 5)
            odds = np.log(prior / (1 - prior)) + np.where(
                cast, np.where(v == 1, np.log(yes / no), np.log((1 - yes) / (1 - no))), 0.0
            ).sum(1)
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        posterior |= {p: float(x) for (p, _, _), x in zip(own, q)}
    return posterior


def _features(pattern: str) -> np.ndarray:
    kind, v, length = _parse(pattern)
    x = np.zeros(len(KINDS) + 2 * len(v) + 6)
    x[KINDS.index(kind)] = 1
    for i, vote in enumerate(v):
        if vote >= 0:
            x[len(KINDS) + 2 * i + vote] = 1
    x[len(KINDS) + 2 * len(v) + length] = 1
    return x


def span_classifier(patterns: dict[str, int], rounds: int = 60, ridge: float = 1.0) -> dict[str, float]:
    """Per vote pattern the probability by a logistic model fitted to the posteriors (Newton's method)."""
    if not patterns:
        return {}
    posterior = reliabilities(patterns)
    names = sorted(patterns)
    x = np.array([_features(p) for p in names])
    n = np.array([patterns[p] for p in names], float)
    y = np.array([posterior[p] for p in names])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {k: float(v) for k, v in zip(names, p)}


SPAN = "struct<kind:string,start:int,end:int,base:boolean,pattern:string>"


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Per document: doc_id and ``spans``, array of (kind, start, end, base), by kind, then start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "pattern"), c)) for c in candidates(t or "")] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "found": found})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(rows.mapInPandas(run, f"doc_id long, found array<{SPAN}>"), "personal-candidates")
    counts = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().toPandas()
    chance = span_classifier(dict(zip(counts["pattern"], counts["count"].astype(int))))
    accepted = sorted(p for p, c in chance.items() if c >= accept)
    keep = F.array(*[F.lit(p) for p in accepted]) if accepted else F.array().cast("array<string>")
    return found.select(
        "doc_id",
        F.transform(
            F.filter("found", lambda s: s["base"] | F.array_contains(keep, s["pattern"])),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")),
        ).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    spans = personal_spans(tables.read(spark, sf_dir, "documents"))

    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(number, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
