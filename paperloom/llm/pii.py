"""Personal data: strict spans, and further spans that boosted trees select among loose candidates.

Base spans (email, ip, card, phone) follow the fixed patterns and checks and always stay. High-recall generators propose
overlapping candidates of the same kinds in looser spellings (other separators, no plus sign, "at" and "dot" written
out). Trees see format features (digit counts, groups, separators, Luhn, octets) and context features (words before, the
characters around), but not what only the strict spelling has. Candidates that are base spans are positive; those that
touch none are unlabelled, not negative: real ones in loose spellings are among them. The trees learn labelled against
unlabelled from the candidates of two thirds of the hashes, or of a hash sample of at most ``SAMPLE`` per kind (half of each)
when there are more.

All candidates of the held-out third are scored and counted by score and label, and an isotonic fit turns scores into
the share of base spans. Base spans are taken as a fair sample of all real ones (Elkan and Noto), so the share among the
held-out candidates that score like the better half of the base spans is the share of real ones that are spelt strictly;
divided by it, a share becomes the probability of being real. Each kind gets the lowest threshold at which the selected
are real with ``PRECISION`` on average and more likely than not at the margin, however many of them are new. Where base
spans are fewer than half of that upper part and hardly more frequent there than among all candidates, the trees cannot
tell them from the rest, and the kind adds nothing; nor does a kind with too few examples. Selected candidates that touch a
base span or a better candidate are dropped.

Null text is empty: no spans. Offsets are code points, end exclusive. Long texts are searched whole in linear time.
Repeated rows are answered one by one. Only doc_id and text are read; other columns pass through ``redact`` unchanged.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.boost import Trees, isotonic
from paperloom.llm.frames import append, documents, restore
from paperloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
LEAST = 50
PRECISION = 0.95

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
# What a text must hold for a loose e-mail address and to be looked at (also read by Arrow, whose \w is ASCII), and the loose spellings
_AT = r"@|(?i:[(\[]at[)\]]| at [^ .\n]{1,64}(?:\.[^ .\n]| ?[(\[]dot| dot ))"
_WORTH = rf"[0-9]|{_AT}"
_LOOSE = {
    "email": re.compile(r"[\w.%+-]{1,64}(?:@| ?[(\[]at[)\]] ?| at )[\w-]{1,64}(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[\w-]{1,64}){1,6}", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,5}(?:(?:\.|,| ?\. ?|\[\.\]| ?[(\[]dot[)\]] ?| dot )[0-9]{1,5}){3}(?![0-9])", re.I),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./_\- –]{0,3}[0-9]){10,23}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?[(]?[0-9](?:[\x20()./\- –]{0,3}[0-9]){6,18}(?![0-9])"),
}
_SPELT_AT = re.compile(r" ?[(\[]at[)\]] ?| at ", re.I)
_SPELT_DOT = re.compile(r" ?[(\[]dot[)\]] ?| dot ", re.I)
_WORDS = {
    "email": "mail e-mail email contact write correo courriel kontakt adresse address",
    "ip": "ip host server address adresse client login node from",
    "card": "card visa mastercard credit debit payment karte carte tarjeta pay",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono number",
    "other": "order invoice isbn version id no ref page figure section date article total",
}
_LEXICON = {w: i for i, ws in enumerate(_WORDS.values()) for w in ws.split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans, by start and then kind as listed."""
    found = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def candidates(text: str) -> list[tuple[str, int, int]]:
    kinds = (["email"] if re.search(_AT, text) else []) + (["ip", "card", "phone"] if _DIGITS.search(text) else [])
    return [(k, m.start(), m.end()) for k in kinds for m in _LOOSE[k].finditer(text)]


def _plain(kind: str, span: str) -> str:
    """The span without its spelling: "@" and "." for what is written out, one space between groups of digits."""
    if kind == "email":
        return _SPELT_DOT.sub(".", _SPELT_AT.sub("@", span))
    return " ".join(_DIGITS.findall(span.lstrip("(").removeprefix("00") if kind == "phone" else span))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = _plain(kind, text[start:end]), text[max(0, start - 48) : start], text[end : end + 2]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    octets = [min(int(g[-6:]), 999) if len(g) < 7 else 999 for g in groups]
    words = re.findall(r"[^\W\d_][\w-]*", before.lower())[-5:]
    hints = [0.0] * len(_WORDS)
    for w in words:
        if w in _LEXICON:
            hints[_LEXICON[w]] += 1
    domain = span.rpartition("@")[2]
    last = re.findall(r"[\w-]+", span)[-1] if span else ""
    return [
        len(digits), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(12 <= len(digits) <= 19 and luhn(digits)), max(octets, default=0), sum(c.isalpha() for c in span), len(set(digits)), int(digits[:1] or 0),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "+-./#"), float(after[:1] in "-/%"), float(after[:1] in ".,;:)"),
        domain.count("."), len(last), float(last.isalpha()), float(len(span)), *hints,
    ]


def _touching(spans: list, start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


def _worth(texts: pa.Array) -> list[tuple[int, str]]:
    """(row, text) of the rows that can hold anything."""
    mask = pc.match_substring_regex(texts.fill_null(""), _WORTH)
    rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    return list(zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()))


def examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, label, order, features) of every candidate of ``docs`` that is a base span or touches none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            rows = []
            for _, own in _worth(batch.column(0)):
                base = base_spans(own)
                strict = set(base)
                for kind, a, b in candidates(own):
                    if (positive := (kind, a, b) in strict) or not _touching(base, a, b):
                        key = hashlib.blake2b(f"{kind}{own[max(0, a - 20) : b + 20]}".encode(), digest_size=7).digest()
                        rows.append((kind, positive, int.from_bytes(key, "big"), features(own, kind, a, b)))
            kinds, labels, order, values = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(labels, pa.bool_()), pa.array(order, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                names=["kind", "label", "order", "features"],
            )

    return docs.select(text).mapInArrow(run, "kind string, label boolean, order long, features array<double>")


def graded(score: np.ndarray) -> np.ndarray:
    """Scores in steps of 1/64, so that those of any number of candidates are counted in few groups."""
    return np.floor(np.clip(score, -32, 32) * 64) / 64


def _held() -> F.Column:
    """A third of the candidates; the order is a hash of the candidate, so copies are on the same side."""
    return F.col("order") % 3 == 0


def held_out(found: DataFrame, trees: dict[str, Trees]) -> DataFrame:
    """(kind, score, label, n): how many of all held-out candidates have each graded score."""
    shared = W.share(found.sparkSession, trees)  # trees of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist(), object)
            values, score = batch.column("features"), np.zeros(batch.num_rows)
            for kind in set(kinds.tolist()):
                own = np.flatnonzero(kinds == kind)
                score[own] = graded(shared()[kind].score(values.take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(score), batch.column("label")], names=["kind", "score", "label"])

    held = found.where(_held() & F.col("kind").isin(list(trees))).select("kind", "label", "features")
    return held.mapInArrow(run, "kind string, score double, label boolean").groupBy("kind", "score", "label").agg(F.count(F.lit(1)).alias("n"))


def calibrated(score: np.ndarray, strict: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Isotonic steps, probabilities and the threshold, from the counts of base spans and unlabelled by ascending score."""
    total = strict + other
    above, above_all = strict[::-1].cumsum()[::-1], total[::-1].cumsum()[::-1]
    at = np.flatnonzero(2 * above >= above[0])[-1]
    spelt_strictly = above[at] / above_all[at]
    if spelt_strictly < 0.5 and spelt_strictly < 1.5 * above[0] / above_all[0]:
        return None
    steps, values = isotonic(score, strict / total, total)
    values = values / spelt_strictly
    own = values[np.maximum(np.searchsorted(steps, score, "right") - 1, 0)]
    for t in np.unique(values):
        chosen = own >= t
        if t > 0.5 and strict[chosen].sum() >= PRECISION * spelt_strictly * total[chosen].sum():
            return steps, np.minimum(values, 1), float(min(t, 1))
    return None


def train(found: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[Trees, np.ndarray, np.ndarray, float]]:
    """By kind: the trees, the isotonic steps and values, and the threshold on the probability."""
    found = cut_lineage(found, "pii-examples")
    sizes = found.groupBy("kind", _held().alias("held"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r["kind"], r["held"], r["label"]): r["n"] for r in sizes}
    trees = {}
    for kind in KINDS:
        strict, other = n.get((kind, False, True), 0), n.get((kind, False, False), 0)
        if min(strict, n.get((kind, True, True), 0)) < LEAST or not other:
            continue
        rows = []
        for label, most in ((True, max(sample // 2, sample - other)), (False, max(sample // 2, sample - strict))):
            own = found.where(~_held() & (F.col("kind") == kind) & (F.col("label") == label))
            rows += own.orderBy("order", F.col("features").cast("string")).limit(most).collect()
        trees[kind] = Trees().fit(np.array([r["features"] for r in rows], float), np.array([r["label"] for r in rows], float))
    counts: dict[str, dict[float, list[int]]] = {kind: {} for kind in trees}
    for r in held_out(found, trees).collect() if trees else []:  # a few thousand scores at most
        counts[r["kind"]].setdefault(r["score"], [0, 0])[not r["label"]] += r["n"]
    models = {}
    for kind, own in counts.items():
        score = np.array(sorted(own))
        strict, other = np.array([own[s] for s in score.tolist()]).T
        if (fitted := calibrated(score, strict, other)) is not None:
            models[kind] = (trees[kind], *fitted)
    return models


def find(text: str, models: dict) -> tuple[list, list]:
    """Base spans, and base and selected spans together; both by start, then kind as listed."""
    base = base_spans(text)
    chosen = []
    loose = [c for c in candidates(text) if c[0] in models and not _touching(base, c[1], c[2])]
    for kind in {c[0] for c in loose}:
        own = [c for c in loose if c[0] == kind]
        trees, steps, values, least = models[kind]
        score = graded(trees.score(np.array([features(text, *c) for c in own], float)))
        p = values[np.maximum(np.searchsorted(steps, score, "right") - 1, 0)]
        chosen += [(-p[i], KINDS.index(kind), c) for i, c in enumerate(own) if p[i] >= least]
    added: list = []
    for _, _, c in sorted(chosen):
        if not _touching(added, c[1], c[2]):
            added.append(c)
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list) -> str:
    """Each run of overlapping spans becomes the name of its first span's kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def spelt(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, models: dict, text: str = "text") -> DataFrame:
    """``docs`` as c0, c1, ... with n_email, n_ip, n_card, n_phone (base), base, spans and the redacted text (null: unchanged)."""
    shared = W.share(docs.sparkSession, models)  # trees of a fixed size

    def compute(batch: pa.RecordBatch, at: int) -> dict:
        n = batch.num_rows
        out = {f"n_{k}": np.zeros(n, np.int64) for k in KINDS} | {"base": [""] * n, "spans": [""] * n, "redacted": [None] * n}
        for i, own in _worth(batch.column(at)):
            base, found = find(own, shared())
            if found:
                for kind, _, _ in base:
                    out[f"n_{kind}"][i] += 1
                out["base"][i], out["spans"][i], out["redacted"][i] = spelt(base), spelt(found), redacted(own, found)
        return out | {k: pa.array(out[k], pa.string()) for k in ("base", "spans", "redacted")}

    return append(docs, compute, ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, redacted string", text)


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced, and ``n_chars``, if there, counted anew for the changed texts."""
    found = spans(docs, train(examples(docs), sample))
    text, changed = F.col(f"c{docs.columns.index('text')}"), F.col("redacted")
    new = {"text": F.coalesce(changed, text)}
    if "n_chars" in docs.columns:
        old = F.col(f"c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(changed.isNull(), old).otherwise(F.length(changed).cast(docs.schema["n_chars"].dataType))
    return restore(docs.columns, found, new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = spans(docs, train(examples(docs)))
    return found.select(F.col("c0").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
